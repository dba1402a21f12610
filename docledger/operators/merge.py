"""Competing extractions: best candidate, precedence merge, best engine, and text from recognised words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds.
MIN_CONFIDENCE = 0.5
MIN_WORD_CONF = 30


def _rank(order: Sequence[str] | None) -> Column:
    """Ordinal of the extractor for ties; unlisted ones come last."""
    out = F.lit(len(order or ()))
    for i, name in enumerate(order or ()):
        out = F.when(F.col("extractor") == name, i).otherwise(out)
    return out


def best_candidate(cands: DataFrame, order: Sequence[str] | None = None, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Highest confidence per (document, field), earlier extractor on ties.

    An aggregate (``max_by``) rather than a ranking window: candidates are reduced before the shuffle and no group is
    held in memory.
    """
    better = F.struct("confidence", (-_rank(order)).alias("r"), F.col("value").alias("v"))
    best = cands.groupBy("doc_id", "field").agg(
        F.max_by(F.struct("value", "confidence", "extractor"), better).alias("b"), F.count("*").alias("n_candidates")
    )
    return best.select("doc_id", "field", "b.*", "n_candidates").withColumn(
        "valid", (F.col("confidence") >= min_confidence) & F.col("value").isNotNull()
    )


# Field of the second extractor and the record field it overrides.
FIELD_MAP = {
    "date": "issue_date",
    "invoice_number": "document_number",
    "amount": "total",
    "amount_untaxed": "subtotal",
    "amount_tax": "tax_amount",
    "vat": "tax_amount",
    "issuer": "seller_name",
    "partner_name": "buyer_name",
    "partner_vat": "buyer_vat",
    "currency": "currency",
    "payment_method": "payment_method",
    "iban": "bank_account",
    "bic": "bic",
}


def merge_precedence(
    primary: DataFrame, secondary: DataFrame, mapping: dict[str, str] | None = None, prefix: str = "alt_", key: str = "doc_id"
) -> DataFrame:
    """Primary records with mapped fields overridden where the secondary has a value; its other fields become metadata."""
    mapping = FIELD_MAP if mapping is None else mapping
    renamed = secondary.select(key, *[F.col(c).alias(f"_s_{c}") for c in secondary.columns if c != key])
    joined = primary.join(renamed, key, "left")
    targets: dict[str, Column] = {}
    for src, dst in mapping.items():
        if src not in secondary.columns:
            continue
        s = F.col(f"_s_{src}")
        value = F.nullif(s, F.lit("")) if dict(secondary.dtypes)[src] == "string" else s
        base = targets.get(dst, F.col(dst) if dst in primary.columns else F.lit(None))
        targets[dst] = F.coalesce(value, base)
    extra = [c for c in secondary.columns if c != key and c not in mapping]
    pairs = [x for c in extra for x in (F.lit(prefix + c), F.col(f"_s_{c}").cast("string"))]
    out = joined.withColumns(targets) if targets else joined
    if extra:
        given = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
        base = F.col("metadata") if "metadata" in primary.columns else None
        out = out.withColumn("metadata", given if base is None else F.map_concat(F.coalesce(base, F.create_map().cast("map<string,string>")), given))
    return out.drop(*[f"_s_{c}" for c in secondary.columns if c != key])


def best_engine(pages: DataFrame, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """Per page the engine with the highest confidence; a failed engine counts as zero, names break ties."""
    conf = F.coalesce("confidence", F.lit(0.0))
    best = pages.groupBy(*keys).agg(
        F.max_by(F.struct("engine", "text", conf.alias("confidence")), F.struct(conf.alias("c"), F.col("engine"))).alias("b")
    )
    return best.select(*keys, "b.*")


def _joined(order: Sequence[str], text: str, sep: str) -> Column:
    """Texts of a bounded layout unit joined in order."""
    entries = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("t"))))
    return F.array_join(F.transform(entries, lambda e: e["t"]), sep)


def _ordered(order: Sequence[str], text: str, others: Sequence[str] = ()) -> Column:
    """Words whose texts are not null, in order, as structs of a text ``t``, ``others`` and the order: all move in lists of their own, half as large as structs."""
    # Lists leave nulls out, so a null is told by a flag before its number; a null order comes first.
    def moved(names: Sequence[str], known: str, number: str) -> list[Column]:
        flags = [F.collect_list(F.col(c).isNotNull()).alias(f"{known}{i}") for i, c in enumerate(names)]
        numbers = [F.collect_list(F.coalesce(c, F.lit(0))).alias(f"{number}{i}") for i, c in enumerate(names)]
        return [x for pair in zip(flags, numbers, strict=True) for x in pair]

    return F.sort_array(F.arrays_zip(*moved(order, "k", "o"), F.collect_list(text).alias("t"), *moved(others, "g", "v")))


def _joined_words(order: Sequence[str], text: str) -> Column:
    """As :func:`_joined` with blanks, of texts that are not null."""
    return F.array_join(F.transform(_ordered(order, text), lambda e: e["t"]), " ")


def words_to_text(words: DataFrame, min_conf: int = MIN_WORD_CONF, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """Confident words of a page in order, mean confidence on 0..1 and word count. A page bounds the group."""
    kept = words.filter((F.col("conf") > min_conf) & (F.trim("text") != ""))
    return kept.groupBy(*keys).agg(
        _joined(["block_no", "line_no", "word_no"], "text", " ").alias("text"),
        (F.avg("conf") / 100).alias("confidence"),
        F.count("*").alias("n_words"),
    )


def quadrant() -> Column:
    """Page quadrant of a word by the midpoint of its box."""
    vertical = F.when(F.col("y") + F.col("h") / 2 < F.col("page_h") / 2, "top").otherwise("bottom")
    side = F.when(F.col("x") + F.col("w") / 2 < F.col("page_w") / 2, "left").otherwise("right")
    return F.concat_ws("-", vertical, side)


def quadrant_text(words: DataFrame, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """Text, mean confidence and boxes of the recognised words of every page quadrant."""
    kept = words.filter((F.col("conf") > 0) & (F.trim("text") != "")).withColumn("quadrant", quadrant())
    order, box = ["block_no", "line_no", "word_no"], ["x", "y", "w", "h"]
    grouped = kept.groupBy(*keys, "quadrant").agg(_ordered(order, "text", box).alias("_words"), F.avg("conf").alias("confidence"), F.count("*").alias("n_words"))

    def boxed(word: Column) -> Column:
        given = [*((c, "k", "o", i) for i, c in enumerate(order)), *((c, "g", "v", i) for i, c in enumerate(box))]
        return F.struct(*(F.when(word[f"{known}{i}"], word[f"{number}{i}"]).alias(c) for c, known, number, i in given))

    return grouped.select(
        *keys, "quadrant", F.array_join(F.transform("_words", lambda e: e["t"]), " ").alias("text"), "confidence", "n_words", F.transform("_words", boxed).alias("boxes")
    )


def layout_lines(words: DataFrame, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """Line texts and the union of their words' boxes."""
    return words.groupBy(*keys, "block_no", "line_no").agg(
        _joined(["word_no"], "text", " ").alias("text"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.max(F.col("x") + F.col("w")).alias("x2"),
        F.max(F.col("y") + F.col("h")).alias("y2"),
    )


def layout_text(words: DataFrame, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """Block texts: words of a line joined with blanks, lines with newlines.

    A block bounds the group, so its words move once and lines are put together inside it.
    """
    entries = F.sort_array(F.collect_list(F.struct("line_no", "word_no", F.col("text").alias("t"))))
    grouped = words.groupBy(*keys, "block_no").agg(entries.alias("_entries"))
    staged = grouped.withColumn("_lines", F.array_distinct(F.transform("_entries", lambda e: e["line_no"])))

    def line(no: Column) -> Column:
        return F.array_join(F.transform(F.filter("_entries", lambda e: e["line_no"].eqNullSafe(no)), lambda e: e["t"]), " ")

    return staged.select(*keys, "block_no", F.array_join(F.transform("_lines", line), "\n").alias("text"), F.size("_lines").cast("bigint").alias("n_lines"))


def page_text(words: DataFrame, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """Page texts: blocks joined with blank lines."""
    return layout_text(words, keys).groupBy(*keys).agg(_joined(["block_no"], "text", "\n\n").alias("text"))
