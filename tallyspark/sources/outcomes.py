"""Raw texts to rows with an error channel: a text that can't be decoded or parsed becomes a failure with a reason, and the others go on."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..shared import materialize

#: From one text to its rows, as tuples in the order of the schema; raises for a text that it can't parse.
Parse = Callable[[str], list[tuple]]


def parse_outcomes(raw: DataFrame, keys: Sequence[str], content: str, parse: Parse, fields: str) -> DataFrame:
    """keys, rows (array of fields), failure and status of each text, one row a text, written once.

    raw: keys and `content`, a text or its bytes, which must be UTF-8. status: failed (with a reason), skipped (null, or
    nothing was found in it) or ok. Each text is parsed on its own, so that nothing is shuffled.
    """
    names = [*keys, "rows", "failure"]
    schema = T.StructType([*(raw.schema[k] for k in keys), T.StructField("rows", T.ArrayType(T.StructType.fromDDL(fields))), T.StructField("failure", T.StringType())])

    def one(value: str | bytes | None) -> tuple[list[tuple], str | None]:
        try:
            return ([] if value is None else parse(value if isinstance(value, str) else bytes(value).decode())), None
        except UnicodeDecodeError as failed:
            return [], f"undecodable text: byte {failed.start}"
        except Exception as failed:  # noqa: BLE001 - whatever a parser raises is a failure of its text, not of the job
            return [], f"{type(failed).__name__}: {failed}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [one(value) for value in batch[content]]
            yield batch[list(keys)].assign(rows=[rows for rows, _ in parsed], failure=[failure for _, failure in parsed])[names]

    done = materialize(raw.select(*keys, content).mapInPandas(run, schema), "outcomes")
    status = F.when(F.col("failure").isNotNull(), "failed").when(F.size("rows") == 0, "skipped").otherwise("ok")
    return done.withColumn("status", status)


def parsed_rows(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of all texts that could be parsed."""
    return outcomes.select(*keys, F.explode("rows").alias("_r")).select(*keys, "_r.*")


def failed_texts(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and reason of the texts that could not; with source_id, ord, status and failure they are the input of an account."""
    return outcomes.where("status = 'failed'").select(*keys, F.col("failure").alias("reason"))
