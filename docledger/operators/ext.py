"""Extension points: own extractors, item functions, model-backed extraction, and a table function for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.functions.checks import Validators
from docledger.operators.items import GENERIC_SHAPES, SEP, SUMMARY_LINE, _template


class Extractors:
    """Extractor per document type: a function from documents to ``candidates`` rows."""

    def __init__(self) -> None:
        self._by_type: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, doc_type: str, fn: Callable[[DataFrame], DataFrame]) -> "Extractors":
        self._by_type[doc_type] = fn
        return self

    def extract(self, docs: DataFrame, default: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Candidates of every typed document; types without an extractor use the default or give none."""
        parts = [fn(docs.filter(F.col("doc_type") == t)) for t, fn in self._by_type.items()]
        if default is not None:
            parts.append(default(docs.filter(~F.col("doc_type").isin(list(self._by_type)))))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def with_items_hook(docs: DataFrame, hook: Callable[[Column], Column], default: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """Items of a custom column function where it finds any, of the default otherwise. Both map text to an item array."""
    staged = docs.withColumn("_own", hook(F.col(text)))
    return staged.withColumn("items", F.when(F.size("_own") > 0, F.col("_own")).otherwise(default(F.col(text)))).drop("_own")


@dataclass(frozen=True)
class Task:
    """A question to a model about one field."""

    field: str
    question: str
    type: str = "text"
    threshold: float = 0.5


# The default questions.
DEFAULT_TASKS = [
    Task("invoice_number", "What is the invoice number?"),
    Task("issue_date", "What is the invoice date or issue date?", "date"),
    Task("due_date", "What is the payment due date?", "date"),
    Task("total_amount", "What is the total amount of the invoice?", "currency"),
    Task("tax_amount", "What is the tax amount or VAT amount?", "currency"),
    Task("vendor_name", "What is the name of the vendor or seller?"),
    Task("customer_name", "What is the name of the customer or buyer?"),
]
WINDOW = 10_000
OVERLAP = 500

# A scorer answers (question, context) with (answer, score).
Scorer = Callable[[str, str], tuple[str, float]]


def _windows(text: str) -> Iterator[tuple[int, str]]:
    """The whole text in overlapping windows a model can take."""
    step = WINDOW - OVERLAP
    for start in range(0, max(len(text) - OVERLAP, 1), step):
        yield start, text[start : start + WINDOW]


def model_extract(
    docs: DataFrame,
    load: Callable[[], Scorer],
    tasks: Sequence[Task] = tuple(DEFAULT_TASKS),
    validators: Validators | None = None,
    extractor: str = "model",
) -> DataFrame:
    """Candidates from a user-supplied scorer, loaded once per Python worker and batch stream.

    Long texts are asked window by window and the best answer is kept, so nothing beyond a model's limit is ignored. An
    answer counts if its score reaches the threshold and its type validates.
    """
    asked = list(tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                for t in asked:
                    best = ("", -1.0, 0)
                    for start, part in _windows(text or ""):
                        answer, s = score(t.question, part)
                        if s > best[1]:
                            best = (answer.strip(), float(s), start + max(part.find(answer), 0))
                    rows.append((doc_id, t.field, t.type, t.threshold, *best))
            yield pd.DataFrame(rows, columns=["doc_id", "field", "type", "threshold", "value", "confidence", "match_pos"])

    schema = "doc_id BIGINT, field STRING, type STRING, threshold DOUBLE, value STRING, confidence DOUBLE, match_pos INT"
    answers = docs.select("doc_id", "text").mapInPandas(run, schema)
    validators = validators or Validators()
    valid = None
    for kind in sorted({t.type for t in asked}):
        check = validators.check(kind, F.col("value"))
        cond = F.col("type") == kind
        valid = F.when(cond, check) if valid is None else valid.when(cond, check)
    kept = answers.filter((F.col("confidence") >= F.col("threshold")) & valid.otherwise(F.lit(False)))
    return kept.select(
        "doc_id", "field", "value", "confidence", F.lit(extractor).alias("extractor"),
        F.lit(None).cast("string").alias("rule_id"), "match_pos", F.col("value").alias("match_text"),
    )


def model_entities(docs: DataFrame, load: Callable[[], Callable[[str], list[tuple[str, str, float]]]], entity: str | None = None) -> DataFrame:
    """Entities (kind, text, score) a user-supplied recogniser finds, optionally of one kind; whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise = load()
        for pdf in batches:
            rows = [
                (doc_id, kind, value, float(score))
                for doc_id, text in zip(pdf["doc_id"], pdf["text"])
                for _, part in _windows(text or "")
                for kind, value, score in recognise(part)
                if entity is None or kind == entity
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "value", "score"])

    out = docs.select("doc_id", "text").mapInPandas(run, "doc_id BIGINT, kind STRING, value STRING, score DOUBLE")
    # Overlapping windows may report an entity twice.
    return out.groupBy("doc_id", "kind", "value").agg(F.max("score").alias("score"))


def register_items_function(spark: SparkSession, name: str = "invoice_items") -> None:
    """SQL table function ``name(text)`` giving one row per item of a text.

    Its body is plain SQL over the generic shapes, so a query using it stays JVM-side:
    ``SELECT d.doc_id, i.* FROM documents d, LATERAL invoice_items(d.text) i``.
    """
    line = "x"
    for pattern, groups in GENERIC_SHAPES:
        line = f"regexp_replace({line}, r'{_sql(pattern)}', '{_sql(_template(groups))}')"
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(doc_text STRING)
        RETURNS TABLE (item_no INT, description STRING, quantity STRING, unit STRING, unit_price STRING, amount STRING)
        RETURN SELECT pos + 1, p[2], nullif(p[3], ''), nullif(p[4], ''), nullif(p[5], ''), p[9]
        FROM posexplode(transform(
            filter(transform(filter(split(doc_text, '\\n'), x -> NOT lower(x) RLIKE r'{SUMMARY_LINE}'), x -> {line}),
                   x -> startswith(x, '{SEP}')),
            x -> split(x, '{SEP}'))) AS t(pos, p)
        """
    )


def _sql(text: str) -> str:
    return text.replace("'", "\\u0027") if "'" in text else text
