"""Mapping tables as TSV, results as JSON, label configurations as YAML."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from ..config import LabelConfig


def write_mapping(mapped: DataFrame, path: str) -> None:
    """A folder of TSV files of 13 columns, one for a small mapping, sorted within and among them; rows without a match have empty cells, junction_f1 four decimals."""
    names = {"gt_stop": "gt_end", "pred_stop": "pred_end"}
    rows = mapped.withColumn("junction_f1", F.when(F.col("predictor").isNotNull(), F.format_string("%.4f", "junction_f1"))).withColumnsRenamed(names)
    rows.orderBy("seqid", "strand", "gt_start", "gt_id", "predictor").write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def to_json(results: dict, path: str | None = None) -> str:
    text = json.dumps(results, indent=2, default=str, sort_keys=True)
    if path:
        Path(path).write_text(text)
    return text


def read_config(path: str) -> LabelConfig:
    """A mapping `role: integer` in YAML: block or flow style, quoted or plain keys and values, under one more key or none."""
    text = "\n".join(line.split("#", 1)[0].rstrip() for line in Path(path).read_text().splitlines() if line.strip() not in ("---", "..."))
    values = {}
    for part in re.split(r"[\n,{}]", text):
        name, colon, value = (x.strip().strip("\"'") for x in part.partition(":"))
        if name and not colon:
            raise ValueError(f"{path}: {part.strip()} is no role with a label")
        if name and (value or name in LabelConfig.__dataclass_fields__):
            values[name] = None if value.lower() in ("", "null", "~") else int(value)
    return LabelConfig(**values)


def write_config(config: LabelConfig, path: str) -> None:
    rows = [f"{k}: {'null' if v is None else v}" for k, v in vars(config).items()]
    Path(path).write_text("# Integer labels of the axis by role\n" + "\n".join(rows) + "\n")
