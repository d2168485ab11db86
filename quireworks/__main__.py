"""``python -m quireworks INPUT.pdf``: converts one document to a book or a raster document."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import compose, convert
from .sources import archive, pdf


def output_path(source: Path, kind: str) -> Path:
    return source.with_name(f"{source.stem}.quireworks.{kind}")


def resolve_format(asked: str | None, output: Path | None) -> str:
    return asked or ("pdf" if output and output.suffix.lower() == ".pdf" else "epub")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quireworks", description="Converts a PDF to a reflowable book or to pages for a device.")
    parser.add_argument("input", type=Path)
    parser.add_argument("-o", "--output", type=Path)
    parser.add_argument("--format", choices=["epub", "pdf"])
    parser.add_argument("--title")
    parser.add_argument("--language", default="en")
    parser.add_argument("--mode", choices=[compose.REFLOW, compose.FIT_WIDTH, compose.FIT_PAGE], default=compose.FIT_WIDTH)
    parser.add_argument("--force", action="store_true", help="replace the output if it exists")
    args = parser.parse_args(argv)
    kind = resolve_format(args.format, args.output)
    target = args.output or output_path(args.input, kind)
    if target.exists() and not args.force:
        print(f"{target} exists; --force replaces it", file=sys.stderr)
        return 1
    began = time.time()
    spark = SparkSession.builder.master("local[*]").appName("quireworks").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    source = f"file://{args.input.resolve()}"
    if kind == "epub":
        row = convert.convert_books(spark, source, args.title or args.input.stem or None, args.language).first()
        content, error = row["content"], row["error"]
    else:
        options = compose.Options(mode=args.mode)
        row = archive.package_rasters(compose.compose_documents(convert.page_rasters(spark, source), options), options.dpi).first()
        failed = pdf.inspect(pdf.read_spans(spark, source)).first()["error"]
        content, error = (row["content"], row["error"]) if row else (None, failed or "no page is a picture")
    if error:
        print(error, file=sys.stderr)
        return 1
    try:
        archive.staged_write(target, bytes(content), args.force)
    except FileExistsError:
        print(f"{target} exists; --force replaces it", file=sys.stderr)
        return 1
    print(f"{target}: {len(content)} bytes in {time.time() - began:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
