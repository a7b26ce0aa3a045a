"""Commands over newline-delimited JSON: get, scan, sentences, tokens, ngrams."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.stem import stemmer_names
from .functions.tokens import TokenSpec
from .functions.words import CLASSES
from .operators.counts import ngrams
from .operators.text import source_sentences, types_of
from .resources import stopword_names, stopwords
from .sources import ndjson


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexmill", description=__doc__)
    p.add_argument("-v", "--version", action="version", version="lexmill 0.1")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, field: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("-o", "--output", help="folder for the result; else standard output")
        if field:
            c.add_argument("-f", "--field", default="text")
        return c

    get = command("get", field=False)
    get.add_argument("field")
    scan = command("scan", field=False)
    scan.add_argument("-l", "--lines", action="store_true", help="also print the type of each line")
    command("sentences").add_argument("-z", "--strict", action="store_true", help="CR and LF end a sentence")
    for name in ("tokens", "ngrams"):
        c = command(name)
        c.add_argument("-k", "--keep", action="append", default=[], choices=["case", "compat", "quote", "ignorable"])
        c.add_argument("-d", "--drop", action="append", default=[], choices=CLASSES)
        c.add_argument("-c", "--combine", action="append", default=[])
        c.add_argument("-s", "--stem", choices=stemmer_names())
        c.add_argument("-t", "--stopwords", choices=stopword_names())
        if name == "ngrams":
            c.add_argument("-n", "--length", type=int, default=1)
    return p


def _spec(a) -> TokenSpec:
    spec = TokenSpec(**{k: False for k in a.keep}, drop_classes=tuple(a.drop), combine=tuple(a.combine), stem=a.stem)
    return spec.without(stopwords(a.stopwords)) if a.stopwords else spec


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = _arguments().parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    lines = ndjson.read_lines(spark, a.path)
    value = F.col("value")

    def emit(df) -> None:
        if a.output:
            ndjson.write_lines(df, a.output)
        else:
            for (x,) in df.toLocalIterator():
                print("null" if x is None else x, file=out)

    if a.command == "get":
        emit(lines.select(ndjson.get_field(value, a.field.strip('"'))))
    elif a.command == "scan":
        if a.lines:
            emit(lines.select(ndjson.type_of(value)))
        t, n = ndjson.scan_schema(lines)
        print(f"{t.render()}\n{n} rows", file=out)
    elif a.command == "sentences":
        field = a.field.strip('"')
        emit(lines.select(source_sentences(ndjson.raw_text(value, field), not a.strict)))
    else:
        types = lines.select(types_of(ndjson.text_of(value, a.field.strip('"')), _spec(a)).alias("types"))
        if a.command == "tokens":
            emit(types.select(ndjson.text_array(F.col("types"))))
        else:
            print(f"Found {ngrams(types.where('types is not null'), a.length).count()} {a.length}-grams.", file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
