"""Quality rules with cross-document line frequency (DataFrame functions only).

Every document gets per-text signals. Its lines are normalised (A-Z lower-cased, white space
dropped) and hashed; for each host the number of distinct documents that carry a line is counted
over the whole corpus. A line above the limit is boilerplate and is removed from every document of
that host except the first (smallest doc_id) that has it, so that one copy of a much-copied
document always survives. A document of which too small a share is left is depleted and rejected.

Scale: one shuffle of narrow (host, line hash, doc) rows with partial aggregation before it; a line
that a third of all documents carry becomes one partial count per task. Texts are not shuffled for
the verdict; `apply_quality_rules` joins them once with the few documents that lose lines.

Defined results: null text is an empty text (base_failed); null host is a host of its own; null
doc_id rows are judged as one document called null; repeated rows count as one document and each
keeps its own output row; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellreach.llm.common import LOWER, SPACES, UPPER, let, row_struct, space_words, unpack

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line in more documents of one host than this is boilerplate.
MAX_DOCS_PER_LINE = 50
#: A document is depleted if less than this percentage of its distinct lines' characters is left.
MIN_LEFT_PERCENT = 30


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = F.transform(
                s,
                lambda x, k: F.when(
                    F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                    | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
                    x["i"],
                ),
            )
            return F.sort_array(F.filter(same, lambda p: p.isNotNull()))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(pairs, twins), total)

    def any_twin(ordered: Column) -> Column:
        return F.exists(
            F.transform(ordered, lambda h, k: F.coalesce(F.get(ordered, k + 1) == h, F.lit(False))), lambda b: b
        )

    hashes = F.when(
        F.size(words) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    return let(
        hashes, lambda h: F.when(let(F.sort_array(h), any_twin), covered(h)).otherwise(F.lit(0).cast("long"))
    )


def _signals(text: Column, words: Column) -> dict[str, Column]:
    plain = F.coalesce(text, F.lit(""))
    with_word = F.filter(F.split(plain, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(plain, SPACES, "")).cast("long"),
        "n_symbols": (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(words, _repeat_words),  # a variable: else every lambda would split the text anew
    }


def _norm_lines(text: Column) -> Column:
    """Normalised lines of the text, blank ones as ''."""
    blanks = SPACES.replace("\n", "")
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + blanks, LOWER), "\n")


def _line_key(line: Column) -> Column:
    return F.xxhash64(line, F.length(line))


def _losses(
    docs: DataFrame, id_col: str, text_col: str, host_col: str, max_docs_per_line: int
) -> DataFrame:
    """(q_id, q_th, q_lost): the boilerplate lines that each document loses, as array<struct<h, n>>."""
    lines = (
        docs.select(
            F.col(id_col).alias("q_id"),
            F.xxhash64(text_col).alias("q_th"),
            F.col(host_col).alias("q_host"),
            F.explode(F.filter(F.array_distinct(_norm_lines(F.col(text_col))), lambda x: x != "")).alias("q_line"),
        )
        .select("q_id", "q_th", "q_host", _line_key(F.col("q_line")).alias("h"), F.length("q_line").alias("n"))
    )
    often = (
        lines.groupBy("q_host", "h")
        .agg((F.count_distinct("q_id") + F.max(F.col("q_id").isNull().cast("int"))).alias("docs"), F.min("q_id").alias("first"))
        .where(F.col("docs") > max_docs_per_line)
        .select(F.col("q_host").alias("o_host"), F.col("h").alias("o_h"), F.col("first"))
    )
    hit = lines.join(often, F.col("q_host").eqNullSafe(F.col("o_host")) & (F.col("h") == F.col("o_h"))).where(
        ~F.col("q_id").eqNullSafe(F.col("first"))
    )
    return hit.groupBy("q_id", "q_th").agg(F.collect_set(F.struct("h", "n")).alias("q_lost"))


def _joined(rows: DataFrame, lost: DataFrame) -> DataFrame:
    other = lost.select(F.col("q_id").alias("l_id"), F.col("q_th").alias("l_th"), "q_lost")
    return rows.join(
        other, (F.col("q_th") == F.col("l_th")) & F.col("q_id").eqNullSafe(F.col("l_id")), "left"
    ).drop("l_id", "l_th")


def _depleted(min_left_percent: int) -> Column:
    gone = F.coalesce(F.aggregate("q_lost", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0))
    return 100 * (F.col("q_chars") - gone) < min_left_percent * F.col("q_chars")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs_per_line: int = MAX_DOCS_PER_LINE,
    min_left_percent: int = MIN_LEFT_PERCENT,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """A row per document: id, its signals, base_failed, kept, and how many of its lines are boilerplate."""
    text = F.col(text_col)
    words = docs.select(
        F.col(id_col).alias("q_id"), text.alias("q_text"), F.xxhash64(text).alias("q_th"), space_words(text).alias("q_words")
    )
    lines = F.array_distinct(_norm_lines(F.col("q_text")))
    rows = words.select(
        "q_id",
        "q_th",
        F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("q_chars"),
        *[c.alias(name) for name, c in _signals(F.col("q_text"), F.col("q_words")).items()],
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    joined = _joined(rows, _losses(docs, id_col, text_col, host_col, max_docs_per_line))
    return joined.select(
        F.col("q_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~_depleted(min_left_percent)).alias("kept"),
        F.coalesce(F.size("q_lost"), F.lit(0)).cast("long").alias("n_boilerplate_lines"),
    )


def apply_quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs_per_line: int = MAX_DOCS_PER_LINE,
    min_left_percent: int = MIN_LEFT_PERCENT,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """The kept documents, with their boilerplate lines taken out of the text; same columns as docs.

    A column n_chars, if there is one, is set to the new length where lines were taken out.
    """
    text = F.col(f"row.`{text_col}`")
    passes = let(
        space_words(text),
        lambda w: F.when(F.size(w) < min_words, F.lit(False)).otherwise(
            100 * _repeat_words(w) <= max_repeat_percent * F.size(w)
        ),
    )
    rows = (
        docs.select(row_struct(docs).alias("row"))
        .where(passes)
        .select(
            "row",
            F.col(f"row.`{id_col}`").alias("q_id"),
            F.xxhash64(text).alias("q_th"),
            F.aggregate(
                F.array_distinct(_norm_lines(text)), F.lit(0).cast("long"), lambda a, x: a + F.length(x)
            ).alias("q_chars"),
        )
    )
    lost = _losses(docs, id_col, text_col, host_col, max_docs_per_line)
    out = _joined(rows, lost).where(~_depleted(min_left_percent))
    gone = F.transform("q_lost", lambda x: x["h"])
    left = F.array_join(
        F.transform(
            F.filter(
                F.arrays_zip(F.split(text, "\n").alias("raw"), _norm_lines(text).alias("norm")),
                lambda z: ~F.array_contains(gone, _line_key(z["norm"])),
            ),
            lambda z: z["raw"],
        ),
        "\n",
    )
    new_text = F.when(F.col("q_lost").isNull(), text).otherwise(left)
    out = out.select("row", "q_lost", new_text.alias("q_text"))
    replaced = {text_col: F.col("q_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        replaced["n_chars"] = F.when(F.col("q_lost").isNull(), F.col("row.n_chars")).otherwise(
            F.length("q_text").cast(kind)
        )
    return unpack(out, "row", docs.columns, **replaced)
