"""Mixing sources to target weights, with DataFrame functions alone.

Every row gets a reproducible random key; within each source, key ranges (buckets) are sorted on
their own and their sums prefixed over the source, so that each row knows how many words stand
before it; the cut is made at the source's exact budget, after as many whole epochs as fit.

Defined results: a null text has no words; a null source is a source of its own, last in order;
a source without words has target 0; repeated rows each count; the key is of doc_id and text, so rows of
one doc_id, or of none, stand apart by their texts, and ties are rows alike; an empty table gives an empty result; further columns are ignored (``take``) or
carried along (``mix``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, md5_key, narrowed, partitions, unit, with_offsets

#: A run of anything but ASCII white space is a word.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def text_md5(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Water-filling over ``source, source_size``: adds ``target`` (double).

    Sources in code point order, null last, take the weights in turn and share ``share`` of all
    sizes; a target stops at ``most`` times its source, the excess goes to the others by weight.
    The sources that stop are those of the least ``most * size / weight``: with k of them stopped,
    the level is (budget - their stops) / (the others' weights), and source k stops if it would
    be above. One row per source, hence the two windows over all of them.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("w", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("stop", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    w = w.withColumn("rest", budget - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
    w = w.withColumn("others", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    w = w.withColumn("stops", F.col("stop") * F.col("others") <= F.col("w") * F.col("rest"))
    level = (budget - F.coalesce(F.sum(F.when(F.col("stops"), F.col("stop"))).over(every), F.lit(0.0))) / F.sum(F.when(~F.col("stops"), F.col("w"))).over(every)
    w = w.withColumn("level", level)
    return w.select("source", "source_size", F.when(F.col("stops"), F.col("stop")).otherwise(F.col("w") * F.col("level")).alias("target"))


def _counted(rows: DataFrame, seed: str, weights, share: float, most: float) -> DataFrame:
    """``rows`` with _doc_id, _source, _size, _text_md5; adds _source_size, _target and _taken.

    What is summed is cut first, without texts: sizes, targets and bucket sums all go over those narrow rows.
    """
    p = partitions(rows.sparkSession)
    rows = rows.withColumn("_key", md5_key(F.col("_doc_id"), F.col("_text_md5"), F.lit(seed))).drop("_text_md5")
    narrow = rows = cut(rows)
    sizes = narrow.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("rows"))
    goal = targets(sizes.select(F.col("_source").alias("source"), "source_size"), weights, share, most)
    every = Window.partitionBy()
    # about two buckets a shuffle partition, dealt to the sources by their rows
    per = sizes.select("_source", F.greatest(F.lit(1), F.ceil(F.col("rows") * (2 * p) / F.sum("rows").over(every))).cast("int").alias("_buckets"))
    goal = goal.join(per, goal["source"].eqNullSafe(per["_source"])).select(
        F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_buckets"
    )

    def bucketed(df: DataFrame) -> DataFrame:
        return df.join(goal, df["_source"].eqNullSafe(goal["_s"])).drop("_s").withColumn("_bucket", F.floor(unit(F.col("_key")) * F.col("_buckets")).cast("int"))

    offsets = with_offsets(bucketed(narrow), ["_source"], "_bucket", {"words": F.sum("_size")})
    offsets = offsets.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "before_words")
    rows = bucketed(rows)
    rows = rows.join(offsets, rows["_source"].eqNullSafe(offsets["_s"]) & (rows["_bucket"] == offsets["_b"])).drop("_s", "_b")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "_doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before_words") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    whole = F.floor(F.col("_target") / F.col("_source_size"))
    rows = rows.withColumn("_start", start)
    rows = rows.withColumn("_epochs", F.when(F.col("_source_size") > 0, whole).otherwise(0).cast("bigint"))
    left = F.floor(F.col("_target")).cast("bigint") - F.col("_epochs") * F.col("_source_size")
    last = F.greatest(F.lit(0), F.least(F.col("_size"), left - F.col("_start")))
    return rows.withColumn("_last", last.cast("bigint")).withColumn("_taken", F.col("_epochs") * F.col("_size") + F.col("_last"))


def take(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): ``doc_id, size, source_size, target, taken``.

    ``taken`` is how many of its words the mix takes, repeats counted; over a source they add up to
    the whole part of its target. The row on which the budget ends is taken in part.
    """
    rows = narrowed(docs, doc_id="bigint", source="string", text="string").select(
        F.col("doc_id").alias("_doc_id"), F.col("source").alias("_source"), words(F.col("text")).alias("_size"), text_md5(F.col("text")).alias("_text_md5")
    )
    out = _counted(rows, seed, weights, share, most)
    return out.select(F.col("_doc_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def mix(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = 1.5, most: float = 2.0, whole: bool = False) -> DataFrame:
    """The mixed rows themselves, with the columns of ``docs``: each row once per whole epoch, and the
    first words of the row on which a source's budget ends (with n_chars, if there, to match). With ``whole``
    that row is taken whole: no text is cut, and a source is above its budget by less than that row.

    What is taken is worked out on narrow rows, without texts. Rows that are alike in every column are named by a hash of 128
    bits and taken together, so texts are dealt once, by that name, to meet what is taken of them.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # the hash passes over nulls, and does not take maps
    told = [x for c, kind in zip(columns, docs.dtypes) for x in (F.to_json(F.struct(c)) if "map<" in kind[1] else c, c.isNull())]
    named = docs.select(F.struct(*columns).alias("_row"), F.xxhash64(*told).alias("_h"), F.xxhash64(F.lit(1), *told).alias("_g"))
    text, source = F.col("_row").getField("text"), F.col("_row").getField("source")
    narrow = named.select("_h", "_g", F.col("_row").getField("doc_id").cast("bigint").alias("_doc_id"), source.cast("string").alias("_source"), words(text).alias("_size"), text_md5(text).alias("_text_md5"))
    part = F.lit(False) if whole else (F.col("_last") > 0) & (F.col("_last") < F.col("_size"))
    taken = _counted(narrow, seed, weights, share, most).where("_taken > 0").groupBy("_h", "_g").agg(
        F.sum(F.col("_epochs") + (~part & (F.col("_last") > 0)).cast("bigint")).alias("_copies"), F.max(F.when(part, F.col("_last"))).alias("_part")  # a source has one row in part at most
    )
    rows = named.dropDuplicates(["_h", "_g"]).join(taken, ["_h", "_g"])
    # 0 stands for the row in part
    copies = F.concat(F.when(F.col("_copies") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))).otherwise(F.array().cast("array<bigint>")), F.when(F.col("_part").isNotNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_copy", F.explode(copies))
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("_part").cast("int")), "")
    rows = rows.withColumn("_text", F.when(F.col("_copy") == 0, head).otherwise(text))
    cols = []
    for c, kind in docs.dtypes:
        own = F.col("_row").getField(c)
        if c == "text":
            own = F.col("_text")
        elif c == "n_chars":
            own = F.when(F.col("_copy") == 0, F.length("_text")).otherwise(own).cast(kind)
        cols.append(own.alias(c))
    return rows.select(*cols)


def oracle() -> str:
    """DuckDB SQL of ``take`` with its defaults over ``documents``."""
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
             md5(coalesce(doc_id::VARCHAR, '∅') || '|' || md5(coalesce(text, '')) || '|mix') AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS stop FROM s),
r AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
        coalesce(sum(stop) OVER b, 0) AS stopped, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS others
      FROM w WINDOW b AS (ORDER BY stop / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, stop * others <= w * (budget - stopped) AS stops FROM r),
g AS (SELECT source, source_size, CASE WHEN stops THEN stop ELSE w * ((budget - coalesce(sum(stop) FILTER (stops) OVER (), 0)) / sum(w) FILTER (NOT stops) OVER ()) END AS target FROM t),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target,
        CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS epochs,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - start)))::BIGINT AS taken FROM p"""
