"""Command line: analyse a CSV or XLSX file and export the tables to a new folder."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .errors import PlenumError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plenum", description=__doc__)
    p.add_argument("input", type=Path)
    p.add_argument("--comment-column", required=True)
    p.add_argument("--date-column")
    p.add_argument("--id-column")
    p.add_argument("--subgroup", action="append", default=[])
    p.add_argument("--sheet")
    p.add_argument("--references", type=Path)
    p.add_argument("--response", type=Path)
    p.add_argument("--minimum-group-size", type=int, default=10)
    p.add_argument("--row-limit", type=int, help="keep only the first rows; all by default")
    p.add_argument("--output-dir", type=Path, required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    """0 on success, 1 on a failure that is told without cell values."""
    from pyspark.sql import SparkSession

    from .operators import clean
    from .plans import analysis, brief
    from .sources import sinks, tables

    args = parser().parse_args(argv)
    try:
        if args.output_dir.exists():
            raise PlenumError("The output folder exists already.")
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
        references = tables.read_references(args.references, args.subgroup) if args.references else None
        response = tables.read_side_text(args.response) if args.response else None
        report = tables.load_table(spark, args.input, sheet_name=args.sheet, row_cap=args.row_limit, preserve_text=True)
        mapped = clean.map_columns(report.df, comment=args.comment_column, order=tables.ORDER, period=args.date_column, respondent=args.id_column, subgroups=args.subgroup)
        result = analysis.analyse(mapped, analysis.Options(references=references, response=response, minimum_group_size=args.minimum_group_size))
        page = brief.build(themes=result.themes, quotes=result.quotes, affect=result.affect, periods=result.periods, mode=result.period_mode, gap_rows=result.gap_rows, top_questions=result.questions["top"])
        bounded = {"themes": result.themes, "quotes": result.quotes, "gap_rows": result.gap_rows, "gap_fields": result.gap_fields, "periods": result.periods}
        payloads: dict[str, object] = {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in bounded.items()}
        sinks.export_json(args.output_dir, payloads | {"brief": page, "warnings": [*report.warnings, *result.notes]})
        result.affect.write.mode("errorifexists").parquet(str(args.output_dir / "affect"))
        result.assignments.write.mode("errorifexists").parquet(str(args.output_dir / "assignments"))
        return 0
    except PlenumError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    except Exception as error:  # never show a message that may quote cells
        print(f"error: the analysis failed ({type(error).__name__})", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
