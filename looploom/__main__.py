"""Command: ``python -m looploom reference -i READS... -r LOCUS... [--nano LONG...] -o FOLDER`` reads files and leaves files."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import SparkSession

from looploom.config import command_line
from looploom.plans import outputs, pipelines
from looploom.sources.sequences import read_sequences, short_names
from looploom.tables import materialize

log = logging.getLogger("looploom")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run the mode that the options name: 0 if a unit was found, 1 if not."""
    args, params = command_line(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, format="%(asctime)s %(message)s")
    if args.mode != "reference" or not args.reference:
        log.error("mode %s needs inputs that only the Python interface takes (looploom.plans.pipelines.tangle_mode)", args.mode)
        return 2
    spark = spark or SparkSession.builder.appName("looploom").getOrCreate()
    reads = short_names(read_sequences(spark, args.reads))
    locus = short_names(read_sequences(spark, args.reference))
    long = materialize(short_names(read_sequences(spark, args.nano)), "nano") if args.nano else None
    orient = read_sequences(spark, args.orient_by_reference).select("seq").first() if args.orient_by_reference else None
    unit, found = pipelines.reference_mode(reads, locus, params, long, orient_by=orient["seq"] if orient else None)
    outputs.write_unit(spark, unit, args.out)
    if found:
        outputs.write_morphs(found, args.out)
    log.info("unit of %d bases, written to %s", len(unit), args.out)
    return 0 if unit else 1


if __name__ == "__main__":
    sys.exit(main())
