"""Operators as stages of a pipeline: documents in, documents with the same columns out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm import toxicity
from lumenlog.llm.chunks import pieces_of, trimmed


def without_toxic(docs: DataFrame, labels: DataFrame, held_out: Column, limit: float = 0.5) -> DataFrame:
    """The documents whose toxicity score stays below the limit; scored and filtered where they are read, with no shuffle."""
    counts = toxicity.language_model(docs)
    strength, base = toxicity.evidence(docs, toxicity.labelled_sample(labels, ~held_out), counts)
    run_key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((counts, strength, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = toxicity._scorer(run_key, sent)
        for batch in batches:
            found = np.array([x for held in pieces_of(batch.column("text")) for x in score(held)], np.float64)
            yield batch.filter(pa.array(found < limit))
        trimmed()

    return docs.mapInArrow(run, docs.schema)


def fifth_by_crc32() -> Column:
    """Whether an id falls into the held-out fifth."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
