"""Next-word model, suggestions and completions over query texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"


def ngram_model(tokens: DataFrame, n: int = 3, col: str = "tokens") -> DataFrame:
    """(ctx, next, cnt): how often `next` follows the n - 1 words `ctx`.

    Each text begins with n - 1 begin marks and ends with an end mark; texts of fewer than two words
    are left out. Windows over a text's words stay within its array; nothing is sorted.
    """
    t = tokens.where(F.size(col) >= 2).select(F.concat(F.array_repeat(F.lit(BEGIN), n - 1), F.col(col), F.array(F.lit(END))).alias("w"))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - (n - 1)))
    t = t.select("w", at.alias("i")).select(F.slice("w", F.col("i"), n - 1).alias("ctx"), F.element_at("w", F.col("i") + n - 1).alias("next"))
    return t.groupBy("ctx", "next").agg(F.count(F.lit(1)).alias("cnt"))


def suggestions(model: DataFrame, prefix: DataFrame, top: int = 8) -> DataFrame:
    """(id, next, cnt, rank) for prefixes (id, tokens): the words most often seen after the last two;
    where there are none, after (begin mark, last word). Marks are no suggestions; ties go by word."""
    last = F.col("tokens")
    two = prefix.where(F.size("tokens") >= 1).select("id", F.slice(F.concat(F.array(F.lit(BEGIN), F.lit(BEGIN)), last), -2, 2).alias("ctx"), F.array(F.lit(BEGIN), F.element_at("tokens", -1)).alias("back"))
    words = model.where(~F.col("next").isin(BEGIN, END))
    direct = two.join(words, "ctx").select("id", "next", "cnt")
    back = two.join(direct.select("id").distinct(), "id", "left_anti").select("id", F.col("back").alias("ctx")).join(words, "ctx").select("id", "next", "cnt")
    w = Window.partitionBy("id").orderBy(F.desc("cnt"), "next")
    return direct.unionByName(back).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def completions(words: DataFrame, prefix: str, top: int = 8) -> DataFrame:
    """(word): the shortest words that begin with the prefix (of two letters or more) and are longer."""
    if len(prefix) < 2:
        return words.select("word").limit(0)
    w = words.where(F.col("word").startswith(prefix) & (F.col("word") != prefix)).select("word").distinct()
    return w.orderBy(F.length("word"), "word").limit(top)


def length_stats(tokens: DataFrame, col: str = "tokens") -> DataFrame:
    """(median, p95) of the number of words."""
    q = tokens.agg(F.percentile(F.size(col), F.array(F.lit(0.5), F.lit(0.95))).alias("q"))
    return q.select(F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"))


def parse_cell(c: Column) -> Column:
    """struct(pt, lo, hi) of a cell "x [lo, hi]"; without an interval only the first number; null if there is none."""
    num = r"[-+−]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
    clean = F.replace(c, F.lit("−"), F.lit("-"))
    full = rf"^\s*({num})\s*\[\s*({num})\s*,\s*({num})\s*\]"
    get = lambda i: F.regexp_extract(clean, full, i).try_cast("double")
    return F.struct(F.coalesce(get(1), F.regexp_extract(clean, f"({num})", 1).try_cast("double")).alias("pt"), get(2).alias("lo"), get(3).alias("hi"))


def markdown_rows(lines: DataFrame, col: str = "line") -> DataFrame:
    """(…, cells): the cells of table lines; ruler lines and other text are left out."""
    t = lines.where(F.col(col).rlike(r"^\s*\|.*\|\s*$") & ~F.col(col).rlike(r"^[\s|:\-]+$"))
    inner = F.regexp_replace(F.col(col), r"^\s*\||\|\s*$", "")
    return t.withColumn("cells", F.transform(F.split(inner, r"\|"), lambda x: F.trim(x)))
