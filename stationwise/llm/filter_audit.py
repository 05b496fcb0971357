"""Filter interaction audit: what each filter removes in every order of the filters, by SQL folds over a few counted cells.

A document fails some of the filters; its failures are the bits of a mask.  What an order of filters does to a document
depends on its mask alone, so documents are counted by part and mask first, at most ``2 ** filters`` cells a part.
Each cell then folds over the array of all orders: an ``aggregate`` along an order carries whether an earlier filter
has removed the cell, a ``transform`` does so for each order, and 5 filters give 600 structs weighted by the cell's counts.
The cells of a part are merged by sums of the arrays' elements; Shapley values are sums of a filter's structs.
All of it is SQL functions: no Python runs on rows, and nothing but counts is shuffled after the masks.

Copies of a text are found by the text's SHA-256.  Their counts are summed by text and part before they meet, so a text
that a third of all rows share is a few rows by then.

Defined results: a null text is an empty one; a null part is the empty string's; a null id counts as larger than any
other; rows that repeat an id and its text are documents of their own, none of which is a copy of the other; a document with
several labels is good or toxic if any of them says so, and one with a null id has none.  Columns beyond those named
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationwise.llm.common import WORD, table, without

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The five filters; E, of copies, needs the other documents.
FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: str | Column = "text") -> Column:
    """The bits of filters A to D, A being 1."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), 0)
    size = F.length(t).cast("long")
    capitals = size - F.length(F.translate(t, CAPITALS, ""))
    fails = lambda c, bit: F.when(c, bit).otherwise(0)
    return F.transform(F.array(words), lambda w: (
        fails(F.size(w) < MIN_WORDS, 1) + fails(100 * F.size(F.array_distinct(w)).cast("long") < MIN_DISTINCT_PERCENT * F.size(w).cast("long"), 2)
    ))[0] + fails(100 * capitals > MAX_CAPITAL_PERCENT * size, 4) + fails(t.rlike(SYMBOLS), 8)


def failure_cells(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``(part, mask, n, good, toxic)``: the documents of a part that fail just the filters of ``mask``."""
    t = F.coalesce(text, F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_failures(text).alias("mask"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_l")).agg(F.max(F.expr("CAST(coalesce(quality = 1, false) AS int)")).alias("good"), F.max(F.expr("CAST(coalesce(toxic = 1, false) AS int)")).alias("toxic"))
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    rows = rows.join(known, F.col("id") == F.col("_l"), "left").select("id", "part", "mask", "digest", *flags)
    same = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy(*same, "id").agg(F.count("*").alias("c"))
    # the least id of a text, nulls last, and how many rows have it
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "c")).alias("least")
    by_text = by_id.groupBy(*same).agg(F.sum("c").alias("n"), least)
    first = F.min(F.struct("least.none", "least.id")).over(Window.partitionBy("digest"))
    is_first = F.struct("least.none", "least.id").eqNullSafe(first)
    unfailed = F.when(F.col("least.none") & is_first, F.col("n")).when(is_first, F.col("least.c")).otherwise(0)
    split = by_text.withColumn("_free", unfailed).select("part", "mask", "good", "toxic", F.inline(F.array(F.struct(F.lit(0).alias("copy"), F.col("_free").alias("m")), F.struct(F.lit(16).alias("copy"), (F.col("n") - F.col("_free")).alias("m")))))
    total = lambda flag: F.sum(F.col("m") * F.col(flag)).alias(flag)
    return split.where("m > 0").groupBy("part", (F.col("mask") + F.col("copy")).alias("mask")).agg(F.sum("m").alias("n"), total("good"), total("toxic"))


def folded(filters: str = FILTERS) -> tuple[str, str]:
    """SQL of the array of all orders (arrays of filter numbers), and of a cell's structs by order and step."""
    orders = json.dumps(list(permutations(range(len(filters)))))
    zero = "named_struct('f', 0, " + ", ".join(f"'{c}', 0L" for c in COUNTS) + ")"
    step = """named_struct('gone', s.gone OR (mask & shiftleft(1, f)) <> 0, 'out', concat(s.out, array(named_struct(
        'f', f,
        'kept', IF(s.gone OR (mask & shiftleft(1, f)) <> 0, 0L, n),
        'removed', IF(NOT s.gone AND (mask & shiftleft(1, f)) <> 0, n, 0L),
        'redundant', IF(s.gone AND (mask & shiftleft(1, f)) <> 0, n, 0L),
        'unique_fails', IF(mask = shiftleft(1, f), n, 0L),
        'good_lost', IF(NOT s.gone AND (mask & shiftleft(1, f)) <> 0, good, 0L),
        'toxic_lost', IF(NOT s.gone AND (mask & shiftleft(1, f)) <> 0, toxic, 0L)))))"""
    fold = f"aggregate(o, named_struct('gone', false, 'out', slice(array({zero}), 1, 0)), (s, f) -> {step}, s -> s.out)"
    return f"from_json('{orders}', 'array<array<int>>')", f"flatten(transform(orders, o -> {fold}))"


def filter_interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order and step from ``cells(part, mask, n, good, toxic)``; longs, mask an int."""
    orders, fold = folded(filters)
    each = cells.withColumn("orders", F.expr(orders)).select("part", F.expr(fold).alias("cell"))
    # at most 2 ** filters cells a part
    parts = each.groupBy("part").agg(F.collect_list("cell").alias("cells"))
    sums = ", ".join(f"'{c}', x.{c} + y.{c}" for c in COUNTS)
    merged = parts.select("part", F.expr(f"aggregate(slice(cells, 2, size(cells)), cells[0], (a, b) -> zip_with(a, b, (x, y) -> named_struct('f', x.f, {sums})))").alias("steps"))
    shapley = F.expr(f"transform(sequence(0, {len(filters) - 1}), k -> aggregate(filter(steps, x -> x.f = k), 0L, (s, x) -> s + x.removed))")
    rows = merged.withColumn("_s", shapley).select("part", "_s", F.posexplode("steps").alias("_k", "_x"))
    letter = lambda k: F.substring(F.lit(filters), k + 1, F.lit(1))
    order = F.expr(f"array_join(transform({orders}[_k div {len(filters)}], f -> substring('{filters}', f + 1, 1)), '')")
    return rows.select("part", order.alias("filter_order"), (F.col("_k") % len(filters) + 1).alias("step"), letter(F.col("_x.f")).alias("filter"), *[F.col(f"_x.{c}").alias(c) for c in COUNTS], F.get("_s", F.col("_x.f")).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    return filter_interactions(failure_cells(docs, labels, doc_id, text, part))


def op13_sql_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without(audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "filter")


OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), m AS (
  SELECT doc_id, part,
         [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
          100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t),
          regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails
  FROM w
), k AS (
  SELECT m.*, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM m LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
                    FROM labels GROUP BY doc_id) l ON l.doc_id = m.doc_id
), letters AS (SELECT unnest(range(5)) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders
), x AS (
  SELECT part, o, step, good, toxic, fails[o[step] + 1] AS hit,
         len(list_filter(o[1:step - 1], lambda f: fails[f + 1])) > 0 AS gone,
         len(list_filter(fails, lambda z: z)) AS n_fails
  FROM k CROSS JOIN steps
), counted AS (
  SELECT part, array_to_string(list_transform(o, lambda f: substr('ABCDE', f + 1, 1)), '') AS filter_order, o[step] AS f, step,
         count(*) FILTER (NOT gone AND NOT hit) AS kept, count(*) FILTER (NOT gone AND hit) AS removed,
         count(*) FILTER (gone AND hit) AS redundant, count(*) FILTER (hit AND n_fails = 1) AS unique_fails,
         count(*) FILTER (NOT gone AND hit AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND hit AND toxic = 1) AS toxic_lost
  FROM x GROUP BY part, o, step
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
