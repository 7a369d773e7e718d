"""Queries over small code samples, for what the driver's prose tables cannot show; tested in tests/."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lexer, scores
from tessera.plans import analysis
from tessera.sources import files as sources
from tessera.sources import settings

SAMPLES: list[tuple[str, str]] = [
    (
        "app/users.ts",
        """import { readRow, saveRow } from "./store";
import type { Shape } from "./shape";

// First, we read the row
export function loadUser(userId: string, unusedFlag: boolean) {
  const row_data = readRow(userId) as any;
  if (row_data !== null) {
    if (row_data !== null) {
      return row_data;
    }
  }
  // @ts-ignore
  return undefined;
}

function neverCalled(first: number, second: number) {
  const totalValue = first + second;
  return totalValue;
}

function alsoNever(first: number) {
  const label = "some repeated text";
  const other = "some repeated text";
  return label + other + "some repeated text" + first;
}

export function deep() {
  try {
    try {
      try {
        saveRow(1);
      } catch (e) { }
    } catch (e) {
      saveRow(2);
    }
  } catch (e) {
    saveRow(3);
  }
}
""",
    ),
    (
        "app/store.go",
        """package store

import (
\t"fmt"
\t_ "net/http"
\tlog "example.com/tools/logger"
)

func Save(name string) error {
\tvalue, _ := parse(name)
\tfmt.Println(value)
\t_ = writeErr(name)
\treturn nil
}

func helperOnly(count int) int {
\treturn count
}
""",
    ),
    (
        "app/tool.py",
        '''import os
from sys import (argv, path as search)

"""Module text with # no comment"""


def main():
    # Next, we look at the arguments
    print(argv, "# not a comment")  # noqa
    return value_of(1)


def value_of(item):
    try:
        return os.getpid()
    except:
        return None


def _left_over(first, second):
    total = first
    return total
''',
    ),
    ("lib/list.c", "#include <stdio.h>\n\nstatic int\nhidden(int count)\n{\n  return count;\n}\n\nstruct node {\n  int value;\n};\n\nint shown(void)\n{\n  return 1;\n}\n"),
    ("app/generated.ts", "// Code generated by a tool\nexport const x = 1;\n"),
    ("app/run.sh", "#!/bin/sh\n# Step 1: build\nbuild() {\n  echo \"${x#y}\"\n}\nbuild\n"),
]
_BODY = "".join(f"  const field{i} = source.read('field{i}') || defaults.field{i};\n  if (!field{i}) {{ throw new Error('field{i}'); }}\n" for i in range(8))
SAMPLES += [
    ("dup/a.ts", "export function fetchProfile(source, defaults) {\n" + _BODY + "  return build(source);\n}\n"),
    ("dup/b.ts", "export function getDetails(source, defaults) {\n" + _BODY + "  return make(source, defaults);\n}\n"),
]


def sample_files(spark: SparkSession) -> DataFrame:
    return sources.from_bytes(spark, [(p, t.encode()) for p, t in SAMPLES], skip=True)


def sample_lines(spark, sf_dir):
    return lexer.shown(lexer.lines(lexer.lex(sources.analysed(sample_files(spark))))).select("path", "line", "kind", "indent", "code")


def sample_functions(spark, sf_dir):
    found = lexer.shown(lexer.tables(sample_files(spark)).functions)
    return found.select("path", "func_idx", "name", "start_line", "end_line", "body_offset", "body_len")


def sample_findings(spark, sf_dir):
    return analysis.check(sample_files(spark), analysis.Options(include_general=True))


def sample_scan(spark, sf_dir):
    return scores.signals(analysis.scan(sample_files(spark)))


def sample_scores(spark, sf_dir):
    return scores.as_json(analysis.scan(sample_files(spark)))


def sample_duplicates(spark, sf_dir):
    return analysis.duplicates(sample_files(spark)).clusters


def sample_analysis(spark, sf_dir):
    return analysis.analyse(sample_files(spark)).select("path", "skipped", "label", "raw_score", F.size("findings").alias("findings"))


def calibration_parse(spark, sf_dir):
    text = json.dumps({"version": 1, "temperature": 1.5, "signals": {k: {"mu_ai": 0.5, "sigma_ai": 0.2, "mu_h": 0.2, "sigma_h": 0.1} for k in ("regularity", "ccr", "ttr")}, "binary": {"decay": {"p_ai": 0.3, "p_h": 0.001}}})
    rows = spark.createDataFrame([(text,)], "value string")
    return settings.as_table(spark, settings.calibration(settings.parse(rows)))


QUERIES = {
    f.__name__: f
    for f in (sample_lines, sample_functions, sample_findings, sample_scan, sample_scores, sample_duplicates, sample_analysis, calibration_parse)
}
