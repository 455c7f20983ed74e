"""Checks a model against analysis profiles: `python -m edgeloom.check MODEL --schema DIR --profile FILE... [--json]`.

Exit code 0: nothing found; 1: violations; 2: the model, schema or a profile cannot be read.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans import validation
from .plans.schema import Schema, empty_model, read_sources
from .sources.readers import read_any


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="edgeloom.check", description=__doc__)
    p.add_argument("model")
    p.add_argument("--schema", action="append", required=True)
    p.add_argument("--profile", action="append", default=[])
    p.add_argument("--json", action="store_true")
    p.add_argument("--most", type=int, default=200, help="violations that are printed of each profile")
    options = p.parse_args(arguments)
    try:
        profiles = [validation.load_profile(path) for path in options.profile]
        schema = Schema.composed(read_sources(options.schema))
        spark = spark or SparkSession.builder.getOrCreate()
        m = read_any(empty_model(spark, schema), options.model)
    except Exception as e:  # noqa: BLE001  whatever cannot be read is exit code 2
        print(f"cannot read: {e}", file=sys.stderr)
        return 2
    found = {q["name"]: validation.validate_for_analysis(m, q) for q in profiles} or {"schema": validation.validate(m)}
    out = {}
    for name, rows in found.items():
        shown = rows.orderBy("entity_class", "entity_id", "field_id", "rule").limit(options.most).collect()
        out[name] = [{k: r[k] for k in ("entity_class", "entity_id", "field_id", "rule", "detail")} for r in shown]
    if options.json:
        print(json.dumps(out, indent=2))
    else:
        for name, rows in out.items():
            print(f"{name}: {'nothing found' if not rows else ''}")
            for r in rows:
                print(f"  [{r['entity_class']}:{r['entity_id']}] {r['rule']} '{r['field_id']}' {r['detail'] or ''}")
    return 1 if any(out.values()) else 0


if __name__ == "__main__":
    sys.exit(main())
