"""User functions as Arrow-batched Spark functions: text rewriting, encoders and predictors."""

import itertools
import random
import re
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from pricelens.functions.scoring import extract_price

# Retry rules of a rewriting service.
MAX_RETRIES = 200
MAX_WAIT = 60.0
EXTRA_WAIT = 0.5
WAIT_PATTERN = re.compile(r"try again in (?:(\d+)m)?([\d.]+)s", re.IGNORECASE)
QUOTA_PHRASES = ("insufficient_quota", "exceeded your current quota", "billing")


class Retryable(Exception):
    """Raised by a user function when the same call may succeed later."""


_QUOTA = re.compile("|".join(map(re.escape, QUOTA_PHRASES)), re.IGNORECASE)


def pause(message: str, attempt: int) -> float:
    """Seconds before the next try: what the service asks for and a little more, or else a doubling time."""
    asked = WAIT_PATTERN.search(message)
    if asked:
        minutes, seconds = asked.groups()
        return 60.0 * float(minutes or 0) + float(seconds) + EXTRA_WAIT
    return min(2.0 ** min(attempt, 60), MAX_WAIT)


def outcome(error: Exception, attempt: int, max_retries: int, can_switch: bool) -> str:
    """What a failed call leads to: `switch` to the other function, `retry`, or `fail`."""
    if not isinstance(error, Retryable):
        return "fail"
    if _QUOTA.search(str(error)):
        return "switch" if can_switch else "fail"
    return "retry" if attempt < max_retries else "fail"


REWRITE_SCHEMA = (
    "key string, summary string, error string, attempts int, model string, "
    "input_tokens bigint, output_tokens bigint, cost double"
)


def rewriter(fn, name="primary", fallback=None, fallback_name="fallback", max_retries=MAX_RETRIES, sleep=time.sleep):
    """A `mapInPandas` function over (key, full) rows.

    `fn(text)` returns a text, or (text, input tokens, output tokens, cost). A failed row carries
    its error and no summary, so it stays pending for the next run instead of ending the job.
    """

    def call(state, text):
        for attempt in itertools.count(1):
            use, model = state[-1]
            try:
                answer = use(text)
            except Exception as error:  # failures of user code are recorded with their row
                next_ = outcome(error, attempt, max_retries, fallback is not None and len(state) == 1)
                if next_ == "fail":
                    reason = str(error) if isinstance(error, Retryable) else f"{type(error).__name__}: {error}"
                    return None, reason, attempt, model, 0, 0, 0.0
                if next_ == "switch":
                    state.append((fallback, fallback_name))
                else:
                    sleep(pause(str(error), attempt) + random.uniform(0, 1))
                continue
            if not isinstance(answer, tuple):
                answer = (answer, len(text.split()), len(answer.split()), 0.0)
            return answer[0].strip(), None, attempt, model, *answer[1:]

    def run(batches):
        state = [(fn, name)]
        for pdf in batches:
            rows = [(key, *call(state, text)) for key, text in zip(pdf["key"], pdf["full"])]
            columns = ["key", "summary", "error", "attempts", "model", "input_tokens", "output_tokens", "cost"]
            yield pd.DataFrame(rows, columns=columns)

    return run


def encode_hook(make_encoder):
    """Column function text -> array<double> from `make_encoder().encode(list of texts)`."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            yield pd.Series(list(np.asarray(encoder.encode(texts.tolist()), dtype=float)))

    return encode


def token_hooks(make_tokenizer, cutoff):
    """Column functions (token count, text cut to `cutoff` tokens) from a tokenizer object."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make_tokenizer()
        for texts in batches:
            yield texts.map(lambda t: 0 if t is None else len(tokenizer.encode(t)))

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make_tokenizer()

        def one(text):
            if text is None:
                return None
            codes = tokenizer.encode(text)
            return tokenizer.decode(codes[:cutoff]).rstrip() if len(codes) > cutoff else text

        for texts in batches:
            yield texts.map(one)

    return count, cut


class Pieces:
    """A sentencepiece vocabulary file as a tokenizer; every machine has the library and the file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def piece_hooks(path: str, cutoff: int):
    """Column functions (count of subword tokens, text cut to `cutoff` of them) from a vocabulary file."""
    return token_hooks(lambda: Pieces(path), cutoff)


def predictor_hook(fn, numeric=True):
    """Column function over item columns from `fn(*values)`, answering with a number or a text."""

    @F.pandas_udf("double" if numeric else "string")
    def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([fn(*values) for values in zip(*columns)])

    def guess(*columns: Column) -> Column:
        answer = predict(*columns)
        return answer if numeric else extract_price(answer)

    return guess
