"""The corpus pipeline: toxic documents out, boilerplate lines out, one of each group of near copies, no benchmark text, token ids.

Each stage takes (spark, docs, sf_dir), works on every row of docs and returns a
DataFrame; all but the last return the columns of documents. loomdoc.llm.stages
states what a stage does with odd rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomdoc.llm.stages import drop_benchmark, drop_lines, drop_near_copies, drop_toxic, to_tokens
from loomdoc.session import dropped, table, written

STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("bpe", to_tokens),
]

#: BPE merges, the label model and the sketch are beyond SQL; tests/llm holds run() against a plain version in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        after = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
