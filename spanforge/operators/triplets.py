"""Triplet mining by seeded places, so that choices repeat on any engine and no pairs are made to choose from.

Each label's items stand in order of a salted md5 and have a place there. An
anchor computes the places it takes and meets them by an equi-join on (label,
place), so the work is a row for each triplet however large a label is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .vectors import dot

#: Digits of the md5 that places are counted by, so that no label is ordered in one task.
DIGITS = 3


def number(*parts: Column | str) -> Column:
    """A number below 2**32 from the md5 of the parts joined by a bar."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def places(items: DataFrame, seed: str | None) -> tuple[DataFrame, DataFrame]:
    """items(id, label) with the place of each among its label's, in order of md5(id|seed), or md5(id) without a seed, and id; and (label, size).

    Items are numbered within ranges of the md5 and written, so that they are made
    once, and the sizes of the ranges before are added: a few rows a label, like the
    labels themselves.
    """
    hashed = items.select("id", "label", F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(seed).cast("string"))).alias("h"))
    hashed = hashed.withColumn("range", F.conv(F.substring("h", 1, DIGITS), 16, 10).cast("int"))
    within = F.row_number().over(Window.partitionBy("label", "range").orderBy("h", "id"))
    numbered = cut(hashed.withColumn("r", within).drop("h"))
    sizes = cut(numbered.groupBy("label", "range").agg(F.count("*").alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = numbered.join(sizes.select("label", "range", before.alias("before")), ["label", "range"])
    return numbered.select("id", "label", (F.col("before") + F.col("r") - 1).alias("place")), sizes.groupBy("label").agg(F.sum("n").alias("size"))


def _taken(wanted: DataFrame, placed: DataFrame, name: str) -> DataFrame:
    """wanted(label, place, ...) with the id that stands there as name."""
    return wanted.join(placed.select("label", "place", F.col("id").alias(name)), ["label", "place"]).drop("label", "place")


def sample(items: DataFrame, per_anchor: int, seed: str, excluded: list[str] | None = None, anchors: Column | None = None) -> DataFrame:
    """(anchor, positive, negative, rank) over items(id, label): a positive of the same label, a negative of another.

    The positives are the items after the anchor among its label's, in a ring; a
    label of n items gives n - 1 of them. The negative's label is one of the
    others by name, and its place there, by md5. Items of excluded labels take
    no part; without a second label there are no triplets. Where anchors is a
    condition on id, only items that meet it are anchors, and only for these is looked.
    """
    items = items.filter(~F.col("label").isin(excluded)) if excluded else items
    placed, sizes = places(items, seed)
    every = sizes.agg(F.sort_array(F.collect_list(F.struct("label", "size"))).alias("labels"))
    asked = placed if anchors is None else placed.filter(anchors)
    rows = asked.join(F.broadcast(sizes), "label").crossJoin(F.broadcast(every))
    rows = rows.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(per_anchor)))).filter("rank < size and size(labels) > 1")
    others = F.filter("labels", lambda x: x["label"] != F.col("label"))
    other = F.element_at(others, (number("id", F.col("rank"), F.lit(f"l{seed}")) % (F.size("labels") - 1) + 1).cast("int"))
    rows = rows.select(F.col("id").alias("anchor"), "rank", "label", ((F.col("place") + F.col("rank")) % F.col("size")).alias("place"), other.alias("o"))
    rows = _taken(rows, placed, "positive")
    negative = number("anchor", "rank", F.lit(f"n{seed}")) % F.col("o.size")
    return _taken(rows.select("anchor", "positive", "rank", F.col("o.label").alias("label"), negative.alias("place")), placed, "negative").select("anchor", "positive", "negative", "rank")


def hard_negatives(errors: DataFrame, pool: DataFrame, seed: str, per_error: int = 3) -> DataFrame:
    """Triplets of errors(id, gold, pred): positives of the gold label, negatives of the label it was taken for.

    Positives and negatives are per_error items of pool(id, label) each, one
    after another from a place by md5; an anchor that is in the pool is never
    its own positive. Where the pool has no item of either label there is no triplet.
    """
    placed, sizes = places(pool, seed)
    side = lambda c: F.broadcast(sizes.select(F.col("label").alias(c), F.col("size").alias(f"{c}_size")))
    rows = errors.select(F.col("id").alias("anchor"), "gold", "pred").join(side("gold"), "gold").join(side("pred"), "pred")
    rows = rows.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(per_error)))).filter("rank <= gold_size and rank <= pred_size")
    start = lambda c, s: (number("anchor", F.lit(f"{s}{seed}")) + F.col("rank") - 1) % F.col(f"{c}_size")
    rows = _taken(rows.select("anchor", "rank", "pred", "pred_size", F.col("gold").alias("label"), start("gold", "p").alias("place")), placed, "positive").filter("anchor <> positive")
    return _taken(rows.select("anchor", "rank", "positive", F.col("pred").alias("label"), start("pred", "n").alias("place")), placed, "negative").select("anchor", "positive", "negative", "rank")


def mix(hard: DataFrame, easy: DataFrame, most: int, hard_ratio: float, seed: str) -> DataFrame:
    """Triplets (anchor, positive, negative, rank) of both kinds with column kind: at most `most`, of which the share hard_ratio is hard.

    The quota of the hard ones is a limit of its own; easy ones fill what they
    leave. Each kind is taken in order of md5, by a distributed top-k.
    """

    def some(rows: DataFrame, kind: str, n: int) -> DataFrame:
        order = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("anchor", "positive", "negative", "rank")], F.lit(seed)))
        return rows.select("anchor", "positive", "negative", "rank", F.lit(kind).alias("kind")).orderBy(order, "anchor", "rank").limit(n)

    first = some(hard, "hard", int(most * hard_ratio))
    return first.unionByName(some(easy, "easy", most - first.count()))


def label_anchored(items: DataFrame, seed: str) -> DataFrame:
    """(anchor, positive, negative): an item with its own label and another one, by name and md5. Labels are broadcast, nothing is shuffled but they."""
    every = items.select("label").distinct().agg(F.sort_array(F.collect_list("label")).alias("labels"))
    rows = items.crossJoin(F.broadcast(every)).filter(F.col("label").isNotNull() & (F.size("labels") > 1))
    others = F.array_remove("labels", F.col("label"))
    other = F.element_at(others, (number("id", F.lit(f"n{seed}")) % F.size(others) + 1).cast("int"))
    return rows.select(F.col("id").alias("anchor"), F.col("label").alias("positive"), other.alias("negative"))


def entity_triplets(entities: DataFrame, seed: str, per_anchor: int = 2, same_doc: float = 0.5, entity_share: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Triplets of entities(doc_id, id, label): with label names, and with other entities.

    The first (anchor, rank, positive, negative) hold an entity's label and
    another one: with probability same_doc one of its own document's, where that
    has another, else any. The second (anchor, positive, negative) hold, for the
    share entity_share of entities, another entity of the label and one of
    another label. All draws are by md5.
    """
    share = lambda *p: number(*p) / float(1 << 32)
    every = entities.select("label").distinct().agg(F.sort_array(F.collect_list("label")).alias("labels"))
    own = entities.select("doc_id", "label").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("label")).alias("own"))
    rows = entities.join(own, "doc_id").crossJoin(F.broadcast(every)).filter("size(labels) > 1")
    rows = rows.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(per_anchor))))
    near, any_ = F.array_remove("own", F.col("label")), F.array_remove("labels", F.col("label"))
    from_doc = (F.size(near) > 0) & (share("id", "rank", F.lit(f"d{seed}")) < same_doc)
    rows = rows.withColumn("others", F.when(from_doc, near).otherwise(any_))
    negative = F.element_at("others", (number("id", "rank", F.lit(f"n{seed}")) % F.size("others") + 1).cast("int"))
    with_labels = rows.select(F.col("id").alias("anchor"), "rank", F.col("label").alias("positive"), negative.alias("negative"))
    drawn = share("id", F.lit(f"e{seed}")) < entity_share
    with_entities = sample(entities.select("id", "label"), 1, seed, anchors=drawn).select("anchor", "positive", "negative")
    return with_labels, with_entities


def loss(triplets: DataFrame, vectors: DataFrame, margin: float = 1.0) -> DataFrame:
    """max(0, |a - p| - |a - n| + margin) of each triplet of ids."""
    for side in ("anchor", "positive", "negative"):
        triplets = triplets.join(vectors.select(F.col("id").alias(side), F.col("vec").alias(f"v_{side}")), side)

    def distance(x: str) -> Column:
        d = F.zip_with("v_anchor", x, lambda a, b: a - b)
        return F.sqrt(dot(d, d))

    return triplets.select("anchor", "positive", "negative", F.greatest(F.lit(0.0), distance("v_positive") - distance("v_negative") + margin).alias("loss"))
