"""python -m causeway.cli {predict,design,explain,diagnose,validate} [--kg FILE] [--param KEY=VALUE ...] [--mode MODE] [--backend NAME] [--json]

The mode baseline needs no graph; without ``--kg`` other modes take the file that $CAUSEWAY_KG names."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from causeway.engine import MODES, Engine
from causeway.sources import kg, models

DEFAULT = "CAUSEWAY_KG"


def parameters(pairs: list[str]) -> dict[str, str]:
    out = {}
    for pair in pairs:
        key, found, value = pair.partition("=")
        if not found or not key.strip():
            raise ValueError(f"not key=value: {pair}")
        out[key.strip()] = value.strip()
    return out


def readable(row: dict) -> str:
    """A result or a source as lines: paths one below the other, JSON answers spread out, empty fields left out."""
    lines = []
    for key, value in row.items():
        if value in (None, "", []):
            continue
        if key == "paths":
            lines += ["paths:", *(f"  {i}. {' -> '.join(p)}" for i, p in enumerate(value, 1))]
        elif key == "response":
            lines += ["answer:", *("  " + x for x in json.dumps(json.loads(value), indent=2, ensure_ascii=False).split("\n"))]
        elif isinstance(value, list):
            lines += [f"{key}:", *(f"  - {json.dumps(x, ensure_ascii=False) if isinstance(x, dict) else x}" for x in value)]
        else:
            lines.append(f"{key}: {value:.3f}" if isinstance(value, float) else f"{key}: {value}")
    return "\n".join(lines)


def main(args: list[str] | None = None) -> list[dict]:
    parser = argparse.ArgumentParser(prog="causeway")
    parser.add_argument("command", choices=["predict", "design", "explain", "diagnose", "validate"])
    parser.add_argument("--kg")
    parser.add_argument("--param", action="append", default=[])
    parser.add_argument("--mode", choices=MODES, default="core")
    parser.add_argument("--direction", choices=["forward", "inverse"], default="forward")
    parser.add_argument("--backend", choices=sorted(models.BACKENDS), default="echo")
    parser.add_argument("--json", action="store_true")
    asked = parser.parse_args(args)
    path = kg.resolve(asked.kg, os.environ.get(DEFAULT, ""))
    if not path and (asked.mode != "baseline" or asked.command == "validate"):
        parser.error(f"--kg is needed, or a file in ${DEFAULT}")
    spark = SparkSession.builder.getOrCreate()
    if asked.command == "validate":
        fine, counts = kg.validate(spark, path)
        found = [{"valid": fine, **counts}]
    else:
        params = parameters(asked.param)
        if not params and asked.command != "diagnose":
            parser.error("at least one --param is needed")
        engine = Engine.from_file(spark, None if asked.mode == "baseline" else path, mode=asked.mode, responder=models.responder(asked.backend))
        if asked.command == "diagnose":
            rows = engine.diagnose(spark)
        else:
            questions = spark.createDataFrame([(0, params)], "query_id int, params map<string,string>")
            direction = "inverse" if asked.command == "design" else asked.direction
            rows = engine.explain(questions, direction) if asked.command == "explain" else engine.answer(questions, direction)
        found = [r.asDict(recursive=True) for r in rows.collect()]  # the answers to one question
    for row in found:
        print(json.dumps(row, ensure_ascii=False) if asked.json else readable(row))
    return found


def tool(args: list[str]) -> dict:
    """``main`` for callers that want no exception: the rows, or an error and a hint."""
    try:
        return {"rows": main(args)}
    except (Exception, SystemExit) as e:  # noqa: BLE001 - the contract of a tool
        return {"error": str(e) or type(e).__name__, "hint": "see python -m causeway.cli --help"}


if __name__ == "__main__":
    main()
