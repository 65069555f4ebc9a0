"""The interface behind which language models sit, and one that replays stored answers."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the message of a passing error has in it.
TRANSIENT = ("503", "UNAVAILABLE", "429", "RESOURCE_EXHAUSTED", "timeout", "Timeout", "TIMEOUT", "deadline", "Deadline", "DEADLINE", "Connection reset", "ECONNRESET", "Server disconnected", "RemoteProtocolError", "timed out")


class Model(Protocol):
    def __call__(self, prompt: str) -> str: ...


class Replay:
    """Answers by the SHA-256 of the prompt; a prompt that isn't stored is an error."""

    def __init__(self, answers: dict[str, str]):
        self.answers = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in answers.items()}

    def __call__(self, prompt: str) -> str:
        return self.answers[hashlib.sha256(prompt.encode()).hexdigest()]


def parsed(answer: Column, schema: str) -> Column:
    """An answer's JSON as a struct, null where it isn't of the schema."""
    told = F.from_json(answer, f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return F.when(told["_corrupt_record"].isNull(), told.dropFields("_corrupt_record"))


def is_transient(message: str) -> bool:
    return any(m in message for m in TRANSIENT)


def with_retry(model: Callable[[str], str], prompt: str, waits: tuple[float, ...] = (2, 6)) -> str:
    """Tries again after each wait where the error is a passing one."""
    for wait in (*waits, None):
        try:
            return model(prompt)
        except Exception as e:
            if wait is None or not is_transient(str(e)):
                raise
            time.sleep(wait)
    raise AssertionError


def ask(rows: DataFrame, model: Model, prompt: str = "prompt", waits: tuple[float, ...] = (2, 6), at_once: int = 8, deadline: float | None = None) -> DataFrame:
    """The rows with answer and error; an error leaves the answer null and drops no row.

    Each task asks ``at_once`` prompts of a batch at a time; what has no answer ``deadline`` seconds after its batch began is an
    error. As many tasks run as the cluster has cores.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pool = ThreadPoolExecutor(at_once)
            ends = None if deadline is None else time.monotonic() + deadline
            asked = [pool.submit(with_retry, model, text, waits) for text in batch.column(prompt).to_pylist()]
            answers, errors = [], []
            for one in asked:
                try:
                    answers.append(one.result(None if ends is None else max(0.0, ends - time.monotonic())))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            pool.shutdown(wait=False, cancel_futures=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
