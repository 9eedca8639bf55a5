"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``. ``run`` writes each stage's
result to shared storage and reads it back for the next one.
"""

from codequarry.llm.common import cut
from codequarry.llm.decontam import decontamination_stage
from codequarry.llm.langid import language_stage
from codequarry.llm.minhash import near_duplicates_stage
from codequarry.llm.packing import packing_stage
from codequarry.llm.pii import pii_stage

STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the language model nor the packing; the tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
