"""How the settings of ``maxent`` and ``toxicity`` are chosen: on a split inside the training rows.

``python -m spanweave.llm.settings FOLDER`` leaves the held-out rows of both operators aside, learns from part of the
training rows, tries settings on the rest of them, and prints a line for each.
"""

import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import maxent, toxicity
from .staging import staged, table

#: The rows on which settings are tried, of those that op10 and op5 may learn from.
LM_ROWS, LM_TRIED = "pmod(crc32(cast(doc_id as string)), 7) <> 2", "pmod(crc32(cast(doc_id as string)), 7) = 3"
TOXIC_ROWS, TOXIC_TRIED = "pmod(crc32(cast(doc_id as string)), 5) <> 0", "pmod(crc32(cast(doc_id as string)), 5) = 1"
#: One setting at a time, the others as they are.
LM = {"RATE": (0.5, 0.65, 0.8), "PRIOR": (1.5, 2.5, 4.0), "LATER_RATE": (0.35, 0.5, 0.65), "LATER_PRIOR": (16.0, 32.0, 64.0)}
TOXIC = {"DISCOUNTS": tuple(tuple(f * x for x in (0.05, 0.008, 0.04)) for f in (0.5, 1.0, 2.0))}


def lm_token_score(docs: DataFrame) -> float:
    """Mean log10 probability of a token of the tried rows."""
    rows = maxent.lm_scores(docs.where(LM_ROWS), f"not ({LM_TRIED})").where("held_out")
    return rows.agg(F.sum("score") / F.sum("n_tokens")).first()[0]


def toxic_auc(docs: DataFrame, labels: DataFrame) -> float:
    """Area under the curve of the tried rows."""
    known = staged(docs.where(TOXIC_ROWS))
    scores = toxicity.toxicity_scores(known, labels.join(known.where(f"not ({TOXIC_TRIED})").select("doc_id"), "doc_id", "left_semi"))
    rows = scores.join(labels, "doc_id").where(TOXIC_TRIED).where("toxic is not null").select("score", "toxic").collect()
    score, toxic = np.array([r.score for r in rows]), np.array([r.toxic for r in rows], bool)
    better = (score[toxic][:, None] > score[~toxic]).mean() + (score[toxic][:, None] == score[~toxic]).mean() / 2
    return float(better)


def tried(module, settings: dict, measure) -> None:
    print(module.__name__, "as it is", round(measure(), 4), flush=True)
    for name, values in settings.items():
        own = getattr(module, name)
        for value in values:
            if value != own:
                setattr(module, name, value)
                print(module.__name__, name, value, round(measure(), 4), flush=True)
        setattr(module, name, own)


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    documents, marks = (table(session, sys.argv[1], x) for x in ("documents", "labels"))
    tried(maxent, LM, lambda: lm_token_score(documents))
    tried(toxicity, TOXIC, lambda: toxic_auc(documents, marks))
