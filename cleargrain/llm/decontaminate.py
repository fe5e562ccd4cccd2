"""Benchmark decontamination as a prefix-filtered set join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.common import ascii_lower
from cleargrain.session import stage

WINDOW = 10  # consecutive item words that count as a leak; a shorter item is one window
SHINGLE = 3  # words of the tokens by which windows are found
BLOCK_BYTES = 16 * 1024 * 1024  # windows that are broadcast at a time
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z: runs of digits, a-z and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), _BREAK), "")


def _tokens(of: str, k: int) -> str:
    """SQL for the hash of each run of ``k`` words in the array column ``of``."""
    parts = ", ".join(f"{of}[i + {j}]" for j in range(k))
    return f"if(size({of}) < {k}, array(), transform(sequence(0, size({of}) - {k}), i -> xxhash64({parts})))"


def windows(items: DataFrame) -> DataFrame:
    """Distinct windows of (item_id, text): win (words), k (words of its tokens), items (ids as text).

    Items without words have no window; a null item_id counts as the empty id.
    """
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    cut = f"transform(sequence(1, greatest(1, size(w) - {WINDOW - 1})), i -> slice(w, i, {WINDOW}))"
    each = rows.select("item", F.explode(F.expr(cut)).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item").alias("items")).withColumn("k", F.least(F.size("win"), F.lit(SHINGLE)))


def _window_tokens(wins: DataFrame, sizes: list[int]) -> DataFrame:
    each = [wins.filter(F.col("k") == k).select("win", "items", F.posexplode(F.expr(_tokens("win", k))).alias("offset", "token")) for k in sizes]
    return reduce(DataFrame.unionByName, each)


def rare_tokens(docs: DataFrame, wins: DataFrame, sizes: list[int]) -> DataFrame:
    """One row per stored window that can occur: win, items, token, offset.

    Tokens are ordered by how often they occur in all documents. A window has to be contained whole, so the prefix that
    finds it is its first token in that order. Windows with a token that no document has are left out.
    """
    tokens = stage(_window_tokens(wins, sizes), "window-tokens")
    distinct = stage(tokens.select("token").distinct(), "window-token-set")
    corpus = docs.select(words(F.col("text")).alias("w")).select(F.explode(F.concat(*[F.expr(_tokens("w", k)) for k in sizes])).alias("token"))
    counts = None
    for block in _blocks(distinct, F.lit(24)):
        own = corpus.join(F.broadcast(block), "token").groupBy("token").count()
        counts = own if counts is None else counts.unionByName(own)
    ranked = tokens.join(counts, "token", "left").groupBy("win").agg(
        F.first("items").alias("items"),
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token", "offset")).alias("rare"),
    )
    return ranked.filter("rare.count > 0").select("win", "items", "rare.token", "rare.offset")


def _blocks(stored: DataFrame, width: Column) -> list[DataFrame]:
    """A stored table cut by token into blocks of about BLOCK_BYTES, by the measured size of its rows."""
    n = -(-int(stored.agg(F.sum(width)).first()[0] or 0) // BLOCK_BYTES)
    return [stored.filter(F.pmod("token", F.lit(n)) == i) for i in range(n)] if n > 1 else [stored]


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Which words of each document lie in a window of a benchmark item.

    Returns doc_id, n_words, n_hit (words inside an occurrence of a window), n_items (items with occurring windows),
    items_sha256 (over their ids, sorted as strings and joined by commas), contaminated (n_hit > 0) and spans (start and
    length, in words, of every occurrence). Null texts have no words; rows with equal doc_id and text give equal rows;
    an empty benchmark hits nothing; other columns are not read.

    The windows are broadcast in blocks of bounded size, so the documents are scanned once per block and never shuffled;
    only occurrences and one row per document are.
    """
    wins = stage(windows(items), "windows")
    sizes = [r[0] for r in wins.select("k").distinct().collect()] or [SHINGLE]  # of 1, 2 and 3 those that occur
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    rare = stage(rare_tokens(docs, wins, sizes), "rare-tokens")
    width = 64 + F.octet_length(F.array_join("win", "  ")) * 2 + F.octet_length(F.array_join("items", "  ")) * 2
    # element 0 stands for the document itself, then the tokens of each length from their first position on
    runs = [f"transform({_tokens('w', k)}, (h, i) -> named_struct('token', h, 'at', i))" for k in sizes]
    marks = "concat(" + ", ".join(["array(named_struct('token', cast(null as bigint), 'at', -1))", *runs]) + ")"
    marked = texts.select("doc_id", "text_key", "w", F.size("w").alias("n_words"), F.explode(F.expr(marks)).alias("t"))
    placed = marked.select("doc_id", "text_key", "w", "n_words", F.col("t.token").alias("h"), F.col("t.at").alias("at"))
    inside = F.expr(
        "h = token and at >= offset and at - offset + size(win) <= n_words and slice(w, at - offset + 1, size(win)) = win"
    )
    found = None
    for i, block in enumerate(_blocks(rare, width)):
        hits = placed.join(F.broadcast(block), inside, "left").filter("win is not null or at < 0").select(
            "doc_id", "text_key", "n_words", F.expr(f"if(at < 0 and {i} = 0, 1, 0)").alias("own"),
            F.expr("at - offset").alias("start"), F.expr("if(win is null, null, size(win))").alias("n"), "items",
        )
        found = hits if found is None else found.unionByName(hits)
    return _summary(found)


def _summary(found: DataFrame) -> DataFrame:
    # one document's occurrences meet here: as many as its words times the windows that end at a word
    each = found.groupBy("doc_id", "text_key").agg(
        F.max("n_words").cast("bigint").alias("n_words"), F.sum("own").alias("rows"),
        F.sort_array(F.collect_set(F.when(F.col("n").isNotNull(), F.struct("start", "n")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = "aggregate(spans, named_struct('n', 0L, 'end', 0), (a, s) -> named_struct('n', a.n + greatest(0, s.start + s.n - greatest(s.start, a.end)), 'end', greatest(a.end, s.start + s.n)), a -> a.n)"
    out = each.withColumn("n_hit", F.expr(covered)).withColumn("copy", F.explode(F.expr("sequence(1L, rows)")))
    return out.select(
        "doc_id", "text_key", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a window of a benchmark item; all columns stay, see ``contamination``."""
    hit = contamination(docs, items).filter("contaminated").select("doc_id", F.col("text_key")).distinct()
    rows = docs.select(F.struct("*").alias("d"))
    same = F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("doc_id")) & (F.xxhash64("d.text") == F.col("text_key"))
    return rows.join(hit, same, "left_anti").select("d.*")
