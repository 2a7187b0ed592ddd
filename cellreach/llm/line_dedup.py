"""Near-duplicate lines across all documents by an exact set-similarity join (DataFrame functions only).

A line is the set of its distinct 5-word shingles (A-Z lower-cased); a line of one to four words is one shingle
(`short_lines=False` leaves such lines alone). Lines with equal sets are one class. Two classes can only be similar
at t if they share one of their first n - ceil(t n) + 1 tokens in an order that all sets keep to (prefix filter). That
is used twice:

1. In the order of the tokens' hashes, over all lines: a class none of whose prefix tokens occurs in another class is settled.
2. For the rest, whose token sets are read again, in the order of rarity: exact counts of every token over those classes,
   ties by hash. Tokens that occur once come first and can match nothing, so they are counted as places but not
   shuffled. Pairs that share a prefix token must pass the length and the positional bound before their sets are compared exactly.

A line is removed if an earlier line (of an earlier document, or an earlier line of the same one) matches it; lines are judged
on the input, not on what is left.

Scale: texts are read three times and shuffled once by document, only documents with lines of step 2. Step 1 shuffles its
prefixes, some fifth of the tokens, once; tokens of hot buckets in salted parts, which step 2 then decides. Each token's
classes are first tried against the one that has it earliest in the order, and only classes that this does not settle
are tried against the other earlier ones, so groups of near copies do not become all their pairs. Nothing but row counts reaches the driver.

Defined results: null, empty and blank texts have no lines to judge. Documents are rows: their order is by id, null ids
last, then by a hash of the text where an id repeats; rows equal in id and text are one document and have the same lines
removed. A document that loses all its words is dropped by `drop_repeated_lines`; empty tables give empty
results; other columns are kept as they are. Tokens and classes are 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cellreach.llm.common import SPACES, RowKey, folded_words, let, released, row_struct, small_side, unpack, written

WIDTH = 5
PERCENT = 80
#: Buckets of the prefix tokens' counts, as bits; fixed, whatever the corpus.
BUCKET_BITS = 16
#: A bucket with so many rows above the average is dealt out in salted parts of about that size.
HOT = 1 << 14


def _tokens(line: Column, width: int, short_lines: bool) -> Column:
    """The distinct 64-bit hashes of the line's shingles, sorted; of fewer words than width one if `short_lines`, else none."""
    def rolled(hashed: Column) -> Column:
        n = F.size(hashed)
        each = F.transform(hashed, lambda h, i: F.xxhash64(h, *[F.get(hashed, i + k) for k in range(1, width)]))
        whole = F.slice(each, F.lit(1), F.greatest(n - (width - 1), F.lit(0)))
        return F.when((n > 0) & (n < width), F.array(F.xxhash64(hashed))).otherwise(whole) if short_lines else whole

    return F.sort_array(F.array_distinct(let(F.transform(folded_words(line), lambda w: F.xxhash64(w)), rolled)))


def _prefix_size(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100).cast("int") + 1


def _judged(texts: DataFrame, width: int, percent: int, short_lines: bool) -> DataFrame:
    """(doc, th, line_no, c, n, prefix) of every line: its class, the number of its tokens, and the first ones by hash."""
    lines = texts.select("doc", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    tokens = lines.select("doc", "th", "line_no", _tokens(F.col("line"), width, short_lines).alias("tokens"))
    n = F.size("tokens")
    first = F.slice("tokens", F.lit(1), F.greatest(_prefix_size(n, percent), F.lit(0)))
    # Lines without tokens are left to the reader of the written table: a filter here would compute the tokens twice.
    return tokens.select("doc", "th", "line_no", F.xxhash64("tokens").alias("c"), n.alias("n"), first.alias("prefix"))


def _hot(rows: DataFrame) -> DataFrame:
    """(bucket, k, parts) of the buckets of tokens that hold many more of the rows than the average; at most 2**BUCKET_BITS."""
    sizes = rows.groupBy(_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("k"))
    extra = F.col("k") - F.floor(F.sum("k").over(Window.partitionBy()) / (1 << BUCKET_BITS))
    return sizes.withColumn("extra", extra).where(F.col("extra") > HOT).select("bucket", "k", (F.floor(F.col("extra") / HOT) + 1).cast("int").alias("parts"))


def _group() -> Column:
    """What the rows of a token, or of one of its salted parts, have in common: one number, by which Spark sorts many times as fast as by two.

    Where two share it by chance, all rows of either do, so every set still has the same order.
    """
    return F.when(F.col("salt").isNull(), F.col("token")).otherwise(F.xxhash64("token", "salt"))


def _bucket() -> Column:
    return F.shiftrightunsigned("token", 64 - BUCKET_BITS)


def _not_alone(judged: DataFrame) -> DataFrame:
    """(c) of the classes that share a prefix token with another, or have one in a hot bucket."""
    rows = judged.select("c", F.xxhash64("doc", "th").alias("spread"), F.explode("prefix").alias("token"))
    dealt = rows.join(F.broadcast(_hot(rows)), _bucket() == F.col("bucket"), "left").select(
        "token", "c", F.pmod("spread", "parts").cast("int").alias("salt")
    ).select(_group().alias("g"), "c", F.col("salt").isNotNull().alias("hot"))
    group = Window.partitionBy("g")
    return (
        dealt.withColumn("lo", F.min("c").over(group))
        .withColumn("hi", F.max("c").over(group))
        .where("hot or lo <> hi")
        .select("c")
        .distinct()
    )


def _sets(texts: DataFrame, classes: DataFrame, width: int, short_lines: bool) -> DataFrame:
    """(c, n, at, tokens) of the classes (c, at), from the lines that bear them first."""
    where = written(
        classes.groupBy(F.col("at.doc").alias("doc"), F.col("at.th").alias("th")).agg(F.collect_set("at.line_no").alias("wanted")),
        "lines-wanted",
    )
    lines = (
        texts.join(small_side(where), ["doc", "th"])
        .select("doc", "th", "wanted", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .where(F.array_contains("wanted", F.col("line_no")))
    )
    tokens = lines.select(F.struct("doc", "th", "line_no").alias("at"), _tokens(F.col("line"), width, short_lines).alias("tokens"))
    return tokens.select(F.xxhash64("tokens").alias("c"), F.size("tokens").alias("n"), "at", "tokens")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, c, n, at, pos): each set's prefix in the order of rarity, without the tokens that no other set has.

    Rarity is the exact count of the token, or, for those of hot buckets, which are counted in salted parts, of the bucket.
    """
    rows = sets.select("c", "n", F.explode("tokens").alias("token"))
    dealt = rows.join(F.broadcast(_hot(rows)), _bucket() == F.col("bucket"), "left").select(
        "token", "c", "n", "k", F.pmod("c", "parts").cast("int").alias("salt")
    ).select(_group().alias("g"), F.when(F.col("salt").isNotNull(), F.col("token")).alias("own"), "c", "n", "k")  # the token once a row
    counted = dealt.select(F.coalesce("own", "g").alias("token"), "c", "n", F.coalesce("k", F.count(F.lit(1)).over(Window.partitionBy("g"))).alias("k")).where("k > 1")
    own = Window.partitionBy("c")
    alone = F.col("n") - F.count(F.lit(1)).over(own)  # tokens of this set only: the rarest, so they come first
    placed = counted.select("token", "c", "n", (alone + F.row_number().over(own.orderBy("k", "token")) - 1).cast("int").alias("pos"))
    return placed.where(F.col("pos") < _prefix_size(F.col("n"), percent)).join(sets.select("c", "at"), "c")


def _matches(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (x, y), those whose sets have a Jaccard similarity of percent or more."""
    both = pairs.join(sets.select(F.col("c").alias("x"), F.col("tokens").alias("tx")), "x").join(
        sets.select(F.col("c").alias("y"), F.col("tokens").alias("ty")), "y"
    )
    shared = both.select("x", "y", F.size(F.array_intersect("tx", "ty")).alias("k"), (F.size("tx") + F.size("ty")).alias("n"))
    return shared.where(100 * F.col("k") >= percent * (F.col("n") - F.col("k"))).select("x", "y")


def _possible(percent: int) -> str:
    most = "least(x.n - x.pos, y.n - y.pos)"  # met at the first token that a similar pair shares
    return (
        f"x.n * 100 >= {percent} * y.n and y.n * 100 >= {percent} * x.n"
        f" and {most} * {100 + percent} >= {percent} * (x.n + y.n)"
    )


def _gone(sets: DataFrame, percent: int) -> DataFrame:
    """(c) of the sets that an earlier one matches."""
    live = written(_prefixes(sets, percent), "lines-prefixes")
    pivots = (
        live.groupBy("token")
        .agg(F.min(F.struct("pos", "at", "c", "n")).alias("p"), F.count(F.lit(1)).alias("k"))
        .where("k > 1")
        .select("token", "p.*")
    )

    def later_first(x: str, y: str) -> list[Column]:
        late = F.col(f"{x}.at") > F.col(f"{y}.at")
        return [
            F.when(late, F.col(f"{x}.c")).otherwise(F.col(f"{y}.c")).alias("x"),
            F.when(late, F.col(f"{y}.c")).otherwise(F.col(f"{x}.c")).alias("y"),
        ]

    tried = written(
        live.alias("x")
        .join(pivots.alias("y"), F.col("x.token") == F.col("y.token"))
        .where(f"x.c <> y.c and {_possible(percent)}")
        .select(*later_first("x", "y"))
        .distinct(),
        "lines-pairs",
    )
    settled = written(_matches(tried, sets, percent).select("x").distinct(), "lines-settled")
    open_ones = live.join(small_side(settled.select(F.col("x").alias("c"))), "c", "left_anti")
    rest = written(
        open_ones.alias("x")
        .join(live.alias("y"), F.col("x.token") == F.col("y.token"))
        .where(f"x.at > y.at and {_possible(percent)}")
        .select(F.col("x.c").alias("x"), F.col("y.c").alias("y"))
        .distinct()
        .join(tried, ["x", "y"], "left_anti"),
        "lines-pairs",
    )
    gone = written(settled.union(_matches(rest, sets, percent).select("x")).distinct().select(F.col("x").alias("c")), "lines-gone")
    released(live, tried, settled, rest)
    return gone


def repeated_lines(
    docs: DataFrame,
    key: RowKey,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
    short_lines: bool = True,
) -> DataFrame:
    """(doc, th, gone) of every document with lines to remove: its key, and their sorted numbers from 0."""
    text = F.col(f"`{text_col}`")
    texts = docs.select(*key.columns(F.col(f"`{id_col}`"), text), text.alias("text"))
    lines = written(_judged(texts, width, percent, short_lines), "lines")
    judged = lines.where("n > 0")
    together = written(_not_alone(judged), "lines-together")
    own = written(judged.select("doc", "th", "line_no", "c"), "lines-own")
    released(lines)
    # Classes of one line that share nothing are of no more use.
    firsts = own.groupBy("c").agg(F.min(F.struct("doc", "th", "line_no")).alias("at"), F.count(F.lit(1)).alias("k"))
    open_ones = small_side(together).withColumn("open", F.lit(True))
    classes = written(firsts.join(open_ones, "c", "left").where("open or k > 1").select("c", "at", "k", F.col("open").isNotNull().alias("open")), "lines-classes")
    sets = written(_sets(key.once(texts), classes.where("open").select("c", "at"), width, short_lines), "lines-sets")
    released(together)
    gone = _gone(sets, percent)
    released(sets)
    states = classes.join(small_side(gone).withColumn("late", F.lit(True)), "c", "left").where("late or k > 1").select("c", "at", "late")
    return (
        own.join(states, "c")
        .where(F.col("late") | (F.col("at") != F.struct("doc", "th", "line_no")))
        .groupBy("doc", "th")
        .agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    )


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, short_lines: bool = True
) -> DataFrame:
    """(id, n_lines, n_removed, removed_lines) of every row: removed_lines are line numbers from 0, comma-joined."""
    key = RowKey(docs, id_col)
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    narrow = docs.select(own.alias("id"), *key.columns(own, text), F.size(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n_lines"))
    return narrow.join(repeated_lines(docs, key, id_col, text_col, width, percent, short_lines), ["doc", "th"], "left").select(
        F.col("id").alias(id_col),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
    )


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, short_lines: bool = True
) -> DataFrame:
    """docs without the repeated lines; a document that had words and has none left is dropped.

    A column n_chars, if there is one, is set to the new length where lines were taken out.
    """
    key = RowKey(docs, id_col)
    packed = docs.select(row_struct(docs).alias("row"))
    rows = packed.select("row", *key.columns(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")))
    out = rows.join(repeated_lines(docs, key, id_col, text_col, width, percent, short_lines), ["doc", "th"], "left")
    text = F.col(f"row.`{text_col}`")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda line, k: ~F.array_contains("gone", k)), "\n")
    out = out.select("row", "gone", F.when(F.col("gone").isNull(), text).otherwise(left).alias("new_text"))
    out = out.where(F.col("gone").isNull() | (F.translate("new_text", SPACES, "") != ""))
    replaced = {text_col: F.col("new_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        replaced["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("new_text").cast(kind))
    return unpack(out, "row", docs.columns, **replaced)
