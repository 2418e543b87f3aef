"""Token and state sequences within a row, so that n-grams and transitions need no shuffle before they are counted.

A state sequence is a string with a letter for each token (``functions.states``). N-grams of letters are found
by one pattern, counted, and spelled out afterwards, when few are left. Everything runs in compiled code.
``explode_outer`` is used throughout: for ``explode`` Catalyst infers a filter that would compute the whole
sequence a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import lexicon as X
from corpusloom.functions import states as ST
from corpusloom.functions.dialect import SPARK


def tokens(text: str = "text", pattern: str = X.TOK_MARKOV) -> Column:
    return F.expr(SPARK.found(f"coalesce({text}, '')", pattern))


def with_states(docs: DataFrame, views: tuple[str, ...] = ST.VIEWS, pattern: str = X.TOK_MARKOV) -> DataFrame:
    """A string of state letters for each of the views asked for; others cost nothing.

    Tokens are found by Spark; a worker looks their letters up (``states.lettered``), as a chain of replacements reads
    the whole text once for each rule. It counts as indeterminate, so that no filter over what follows runs it again.
    """
    kept = [c for c in docs.columns if c not in views]
    letters = F.arrow_udf(ST.lettered(views), ", ".join(f"{v} string" for v in views)).asNondeterministic()
    made = docs.select(*kept, letters(F.array_join(tokens(pattern=pattern), ST.WAITS)).alias("_states"))
    return made.select(*kept, *(F.col(f"_states.{v}").alias(v) for v in views))


def exploded(df: DataFrame, keep: tuple[str, ...], items: Column, name: str) -> DataFrame:
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def grams(seq: str, n: int) -> Column:
    """All runs of n letters, in order of their start."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{n}}}))."), F.lit(1))


def spelled(gram: Column, n: int, sep: str = "|") -> Column:
    """The names of the n letters of a gram."""
    return F.concat_ws(sep, *(ST.spelled(F.substring(gram, k + 1, 1)) for k in range(n)))


def state_counts(df: DataFrame, view: str) -> DataFrame:
    """doc_id, state, n. A row's counts are made within it, so that only a few rows for each document travel."""
    seq = F.col(view)
    n = lambda s: F.length(seq) - F.length(F.replace(seq, F.lit(ST.letter(view, s))))
    per = F.array(*(F.struct(F.lit(s).alias("state"), n(s).alias("n")) for s in ST.STATES[view]))
    rows = df.select("doc_id", F.explode_outer(per).alias("s")).filter("s.n > 0")
    return rows.groupBy("doc_id", "s.state").agg(F.sum("s.n").alias("n"))


def words(text: str = "text") -> Column:
    """Lower-cased words with a line end between them."""
    return F.lower(F.array_join(tokens(text, X.TOK_WORD), ST.WAITS))


def word_bigrams(joined: str) -> Column:
    return F.regexp_extract_all(joined, F.lit(r"(?=([^\n]+\n[^\n]+))[^\n]+"), F.lit(1))


def runs(seq: str) -> Column:
    """Runs of equal letters, in order."""
    return F.regexp_extract_all(seq, F.lit(r"(.)\1*"), F.lit(0))


def transitions(df: DataFrame, views: tuple[str, ...], orders: tuple[int, ...] = (1,), keep: tuple[str, ...] = (), none: bool = False) -> DataFrame:
    """``gram`` for every transition, with the columns of ``keep``; one pass over the rows. Letters tell the view, length the order.

    With ``none`` each row also has, for every view and order, one gram of letters that stand for no state.
    """
    each = [grams(v, o + 1) for v in views for o in orders]
    if none:
        each.append(F.array(*(F.lit(ST.none_letter(v) * (o + 1)) for v in views for o in orders)))
    return exploded(df, keep, F.concat(*each), "gram")


def told(df: DataFrame) -> DataFrame:
    """view, ord, context and next of a gram in place of it."""
    size = F.length("gram")
    named = F.concat_ws("|", *(F.when(size > k + 1, ST.spelled(F.substring("gram", k + 1, 1))) for k in range(4)))
    at = {"view": ST.view_of(F.col("gram")), "ord": (size - 1).cast("int"), "context": named, "next": ST.spelled(F.substring(F.col("gram"), -1, 1))}
    return df.withColumns(at).drop("gram")


def top_ngrams(df: DataFrame, seq: str, orders: tuple[int, ...] = (2, 3), limit: int = 48) -> DataFrame:
    """Per document and order the most frequent n-grams; ties go by first appearance.

    Only the letters travel, by document; counts, places and cuts are made where they arrive.
    """
    near = df.select("doc_id", seq).repartition("doc_id")
    found = near.select("doc_id", F.posexplode_outer(F.concat(*(grams(seq, n) for n in orders))).alias("pos", "gram")).filter("gram is not null")
    counted = found.groupBy("doc_id", "gram").agg(F.count("*").alias("n"), F.min("pos").alias("first")).withColumn("ord", F.length("gram"))
    place = F.row_number().over(W.partitionBy("doc_id", "ord").orderBy(F.desc("n"), "first"))
    kept = counted.withColumn("place", place).filter(F.col("place") <= limit)
    name = F.concat_ws("_", *(F.when(F.col("ord") > k, ST.spelled(F.substring("gram", k + 1, 1))) for k in range(max(orders))))
    return kept.select("doc_id", F.col("ord").cast("int").alias("ord"), name.alias("gram"), "n")
