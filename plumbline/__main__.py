"""python -m plumbline QUERY TABLE_DIR: runs a registered query and shows its rows; without arguments, lists the queries.

python -m plumbline calibrate RECORDS.jsonl GATE.json [ALPHA]: fits a gate from lines {"score", "loss", "group"}.
python -m plumbline ingest FOLDER STORE CHECKPOINTS: takes JSON lines of pages or chunks into a chunk store.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession


def calibrate(records: str, out: str, alpha: str = "0.1") -> int:
    from plumbline.operators.answering import calibrate_gate
    from plumbline.sources.writers import write_json

    rows = SparkSession.builder.getOrCreate().read.schema("score double, loss double, `group` string").json(records)
    try:
        gate = calibrate_gate(rows.na.fill({"group": "_global"}), float(alpha), "group")
    except ValueError as refused:
        print(refused, file=sys.stderr)
        return 1
    write_json(out, gate)
    return 0


def main(argv: list[str]) -> int:
    from plumbline.plans import registry

    if argv[:1] == ["calibrate"] and len(argv) in (3, 4):
        return calibrate(*argv[1:])
    if argv[:1] == ["ingest"] and len(argv) == 4:
        from plumbline.streaming.ingest import start_ingest

        start_ingest(SparkSession.builder.getOrCreate(), *argv[1:]).awaitTermination()
        return 0
    names = registry.queries()
    if len(argv) < 2:
        print("\n".join(sorted(names)))
        return 0
    if argv[0] not in names:
        print(f"no query {argv[0]!r}", file=sys.stderr)
        return 2
    names[argv[0]](SparkSession.builder.getOrCreate(), argv[1]).show(20, truncate=120)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
