"""Command line: scan, verify, compile, version, help."""

from __future__ import annotations

import os
import sys
import time

from veldtext.config import VERSION, ScanConfig
from veldtext.sources import signatures as S

USAGE = f"""veldtext {VERSION}

  veldtext scan PATH... [-r] [-t N] [--json] [-q] [--sigfile FILE] [--key KEY] [-v]
  veldtext verify FILE [--key KEY]
  veldtext compile -i PATTERNS -o FILE [-k KEY] [-s SALT] [-v]
  veldtext version

Exit status: 0 nothing is blocked, 1 an error, 2 a file is blocked."""
_SCAN = {"-r": "", "--recursive": "", "-t": "threshold", "--threshold": "threshold", "--json": "", "-q": "", "--quiet": "", "--sigfile": "sigfile", "--key": "key", "-v": "", "--verbose": ""}
_COMPILE = {"-i": "input", "--input": "input", "-o": "output", "--output": "output", "-k": "key", "--key": "key", "-s": "salt", "--salt": "salt", "-v": "", "--verbose": ""}
_LONG = {"-r": "recursive", "--json": "json", "-q": "quiet", "-v": "verbose"}


class UsageError(Exception):
    pass


def parsed(args: list[str], flags: dict[str, str]) -> tuple[dict, list[str]]:
    """Options and other words. A flag at the end without its value is ignored; an unknown flag raises."""
    options, words, rest = {}, [], iter(args)
    for arg in rest:
        if arg in flags:
            if not flags[arg]:
                options[_LONG.get(arg, arg.lstrip("-"))] = True
            elif (value := next(rest, None)) is not None:
                options[flags[arg]] = value
        elif arg.startswith("-"):
            raise UsageError(f"Unknown flag: {arg}")
        else:
            words.append(arg)
    return options, words


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("veldtext").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scan_command(args: list[str], spark=None) -> int:
    options, paths = parsed(args, _SCAN)
    if not paths:
        raise UsageError("no scan path specified")
    try:
        config = ScanConfig(threshold=float(options.get("threshold", 80)))
    except ValueError:
        raise UsageError(f"Invalid threshold: {options['threshold']}") from None
    file = options.get("sigfile") or next((p for p in S.DEFAULT_PATHS if os.path.exists(p)), None)
    if not file:
        raise UsageError("no signature file found; name one with --sigfile")
    found = S.read(file, S.key_for_scan(options.get("key")))
    if options.get("verbose"):
        print(f"{file}: {len(found.hashes)} hashes, a filter of {found.bloom.size} bits", file=sys.stderr)

    from veldtext.operators import report
    from veldtext.operators.scan import scan_paths
    from veldtext.sources.files import text_files

    began, sources, spark = time.time(), [], spark or _session()
    for path in paths:
        try:
            sources.append(text_files(spark, path, config))
        except OSError as error:
            print(f"Error scanning {path}: {error}", file=sys.stderr)
    if not sources:
        empty = spark.createDataFrame([], "path string, text string")
        sources.append(empty)
    results = scan_paths(sources, found, config).cache()
    try:
        if options.get("json"):
            for part in report.report_parts(results, config.threshold, began):
                print(part, end="")
            print()
        else:
            results.count()
            print(report.console(results, config.threshold, time.time() - began, bool(options.get("quiet"))), end="")
        return report.exit_status(results)
    finally:
        results.unpersist()


def verify_command(args: list[str]) -> int:
    if not args:
        raise UsageError("veldtext verify FILE [--key KEY]")
    options, _ = parsed(args[1:], {"--key": "key"})
    with open(args[0], "rb") as file:
        data = file.read()
    try:
        S.verify(data, options.get("key", "").encode() or S.DEFAULT_KEY)
    except S.SignatureError as error:
        print(f"FAILED: {error}", file=sys.stderr)
        return 1
    print("OK: signature file integrity verified")
    return 0


def compile_command(args: list[str], spark=None) -> int:
    options, _ = parsed(args, _COMPILE)
    if not options.get("input") or not options.get("output"):
        raise UsageError("both -i (input) and -o (output) are required")

    from veldtext.operators.match import compile_signatures
    from veldtext.sources.files import pattern_file

    spark = spark or _session()
    patterns = pattern_file(spark, os.path.abspath(options["input"]))
    found = compile_signatures(patterns, S.salt_of(options.get("salt")))
    S.write(options["output"], found, options.get("key", "").encode() or S.DEFAULT_KEY)
    if options.get("verbose"):
        print(f"a filter of {found.bloom.size} bits and {found.bloom.hashes} functions", file=sys.stderr)
    print(f"Compiled {len(found.hashes)} patterns into {options['output']}")
    return 0


def main(args: list[str] | None = None, spark=None) -> int:
    args = sys.argv[1:] if args is None else args
    command = args[0] if args else None
    try:
        if command == "scan":
            return scan_command(args[1:], spark)
        if command == "verify":
            return verify_command(args[1:])
        if command == "compile":
            return compile_command(args[1:], spark)
    except (UsageError, OSError, ValueError) as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    if command == "version":
        print(f"veldtext {VERSION}")
        return 0
    print(USAGE)
    return 0 if command in ("help", "--help", "-h") else 1


if __name__ == "__main__":
    sys.exit(main())
