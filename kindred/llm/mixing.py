"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Sources get targets in words.  The rates at which documents are taken are those
nearest (in relative entropy, each word of the corpus weighing the same) to
taking every document once that meet all targets and, besides, keep the corpus's
mean of the logarithm of document length, as far as a small penalty allows:

    rate = min(MOST, exp(multiplier of the source + tilt * length of the document))

where length is the logarithm of the size, standardised over the words of the
corpus.  So a source that is taken more often takes rather its long or its short
documents, whichever keeps the mix like the corpus.  The multipliers and the
tilt minimise the convex dual,

    sum over documents of size * integral of rate - target * multiplier + penalty * tilt^2 / 2,

by Newton's method.  Gradient and Hessian are sums over documents, which are
first pre-aggregated to distinct (source, size); the tilt couples all sources,
and its step comes from the Schur complement of the sources' diagonal.  The
multipliers stay in a table.  Rates are then rounded into copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, durable, fresh_name, n_words

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Copies of a document at most, and so the greatest target as a multiple of the source's size.
MOST = 3
#: Documents that are rounded together, about.
BUCKET = 1024
#: Sources up to which the table of sources is sent to all tasks (some 50 bytes each); beyond, it is joined by a shuffle.
SENT = 100_000
#: Newton stops at this relative distance of every source from its target, or after so many steps.
TOLERANCE, STEPS = 1e-7, 60
#: Penalty on the tilt, as a share of the words' variance of length.
RIDGE = 0.1


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    Sources in code-point order, null last, weigh `weights`, repeating.  They
    share the sum of all sizes by weight; a target stops at `most` times its
    source's size and the excess is shared anew by weight until none is above.
    All of it is worked out by sums over tables of sources.
    """
    spread = sizes.select("source", "source_size")
    # The place of a source is the number of sources before it, from a range sort; no single task sees all.
    ordered = spread.orderBy(F.col("source").asc_nulls_last()).select("source", "source_size", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    ordered = durable(ordered)
    before, held = {}, 0
    for p, n in sorted(ordered.groupBy("p").count().collect()):  # one row for each partition
        before[p], held = held, held + n
    start = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0), F.lit(0))
    place = F.element_at(start, F.col("p")) + F.col("m") % (1 << 33)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    table = durable(ordered.select("source", "source_size", weight.alias("w")).withColumn("full", F.lit(False)))
    while True:
        free = table.agg(F.sum("source_size"), F.sum(F.when(F.col("full"), F.col("source_size") * most).otherwise(0)), F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0))).first()
        share = ((free[0] or 0) - (free[1] or 0)) / free[2] if free[2] else 0.0
        above = (F.col("w") * F.lit(share)) > (F.col("source_size") * most)
        table = durable(table.withColumn("above", ~F.col("full") & above))
        if not table.where("above").limit(1).count():
            target = F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(F.col("w") * F.lit(share))
            return table.select("source", "source_size", target.alias("target"))
        table = table.withColumn("full", F.col("full") | F.col("above")).drop("above")


def with_length(cells: DataFrame) -> DataFrame:
    """Cells (size, docs, ...) with `length`, the logarithm of size, of mean 0 and variance 1 over all words (0 if all are equal)."""
    log, words = F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")), F.col("size") * F.col("docs")
    of = cells.agg(F.sum(words).alias("w"), F.sum(words * log).alias("s"), F.sum(words * log * log).alias("q")).first()
    mean = (of["s"] or 0.0) / of["w"] if of["w"] else 0.0
    variance = max(0.0, (of["q"] or 0.0) / of["w"] - mean * mean) if of["w"] else 0.0
    return cells.withColumn("length", (log - mean) / variance**0.5 if variance > 1e-12 else F.lit(0.0))


def balance(sources: DataFrame, cells: DataFrame, most: int = MOST, ridge: float = RIDGE) -> tuple[DataFrame, float]:
    """(`sources` with `lam`, tilt): what minimises the dual.

    `sources` has (source, source_size, target); `cells` has (source, size,
    docs, length).  Sources whose target is nothing have lam null and rate 0;
    those whose target is all they can give, `most` times their size, have an
    infinite one and rate `most`.  Both are rounded to nine digits, so that
    another order of the sums gives the same rates.
    """
    c = F.col
    full = (c("source_size") > 0) & (c("target") >= most * c("source_size") * (1 - 1e-12))
    live = (c("source_size") > 0) & (c("target") > 0)
    now = durable(sources.withColumn("lam", F.when(full, float("inf")).when(live, F.log(c("target") / F.greatest(c("source_size"), F.lit(1))))))
    tilt = 0.0
    words = cells.agg(F.sum(c("size") * c("docs"))).first()[0] or 0
    for _ in range(STEPS):
        rate = F.exp(c("lam") + tilt * c("length"))
        mass, free = c("size") * c("docs") * F.least(F.lit(float(most)), rate), rate < most
        inside = F.when(free, mass).otherwise(0.0)
        sums = cells.join(now.select(c("source").alias("its_source"), "lam"), c("source").eqNullSafe(c("its_source"))).where("lam is not null").groupBy("source").agg(
            F.sum(mass).alias("mass"), F.sum(inside).alias("m"), F.sum(inside * c("length")).alias("a"), F.sum(inside * c("length") * c("length")).alias("b"), F.sum(mass * c("length")).alias("q"),
        )
        sums = sums.withColumnRenamed("source", "its_source")
        state = durable(now.join(sums, c("source").eqNullSafe(c("its_source")), "left").drop("its_source"))
        fixed = c("lam").isNull() | (c("lam") == float("inf"))
        short, curve = c("target") - c("mass"), F.greatest(c("m"), c("mass") * 1e-3)
        at = state.agg(
            F.max(F.when(~fixed, F.abs(short) / c("target"))).alias("worst"), F.sum("q").alias("q"), F.sum(F.when(~fixed, c("b") - c("a") * c("a") / curve)).alias("schur"),
            F.sum(F.when(~fixed, c("a") * short / curve)).alias("pull"),
        ).first()
        gradient = -(at["q"] or 0.0) - ridge * words * tilt
        near = (at["worst"] or 0.0) <= TOLERANCE and abs(gradient) <= TOLERANCE * max(words, 1)
        # Far from the optimum a full step overshoots; steps of one unit at most keep the dual falling.
        bend = (at["schur"] or 0.0) + ridge * words
        step = max(-1.0, min(1.0, (gradient - (at["pull"] or 0.0)) / bend)) if bend > 0 else 0.0
        tilt += step
        move = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (short - c("a") * step) / curve))
        now = durable(state.select(*sources.columns, F.when(fixed, c("lam")).otherwise(c("lam") + move).alias("lam")))
        if near:  # one step more, so that what is left is far below the digits that are kept
            break
    return now.withColumn("lam", F.round("lam", 9)), round(tilt, 9)


def _round(rows: Column, most: int) -> Column:
    """Copies for documents in falling order of size: what rounding gains or loses passes to the next."""
    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<int>").alias("copies"))

    def step(acc: Column, row: Column) -> Column:
        due = acc["owed"] + row["size"] * row["rate"]
        n = F.when(row["size"] > 0, F.greatest(F.lit(0), F.least(F.lit(most), F.floor(due / row["size"] + 0.5)))).otherwise(0).cast("int")
        return F.struct((due - n * row["size"]).alias("owed"), F.concat(acc["copies"], F.array(n)).alias("copies"))

    return F.aggregate(rows, start, step, lambda acc: acc["copies"])


def mix(docs: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, again, source, size, source_size, target, rate, copies, taken), one row for each document.

    `again` tells rows with the same key, source and size apart.  Rounding
    sends the documents of a source, in buckets of about BUCKET by a hash of
    their key, from long to short; a bucket misses its share of the target by
    about half its shortest document.  A null text has size 0 and copies 0; a
    null source is a source of its own, the last; null keys are kept; results
    do not depend on the order or partitioning of the rows; an empty table
    stays empty.
    """
    c = F.col
    tables = Tables(docs.sparkSession)
    # Equal rows are counted, so that a key that comes very often is one row here; texts are read once only.
    unique = tables.keep(docs.select(c(key).alias("key"), "source", n_words().alias("size")).groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    cells = tables.keep(with_length(tables.keep(unique.groupBy("source", "size").agg(F.sum("rows").alias("docs")))))
    sources = durable(cells.groupBy("source").agg(F.sum(c("size") * c("docs")).alias("source_size"), F.sum("docs").alias("source_docs")))
    rated, tilt = balance(targets(sources, weights, most).join(sources.select(c("source").alias("its_source"), "source_docs"), c("source").eqNullSafe(c("its_source"))).drop("its_source"), cells, most)
    facts = rated.select(c("source").alias("its_source"), "source_size", "target", "lam", "source_docs")
    if rated.count() <= SENT:  # else a source with very many documents is left to the skew join
        facts = F.broadcast(facts)
    lengths = cells.select(c("source").alias("s"), c("size").alias("n"), "length")
    spread = unique.join(lengths, c("source").eqNullSafe(c("s")) & (c("size") == c("n"))).drop("s", "n").join(facts, c("source").eqNullSafe(c("its_source"))).drop("its_source")
    spread = spread.withColumn("rate", F.coalesce(F.least(F.lit(float(most)), F.exp(c("lam") + tilt * c("length"))), F.lit(0.0)))
    bucket = F.pmod(F.xxhash64("key", "size"), F.greatest(F.lit(1), F.ceil(c("source_docs") / BUCKET)))
    spread = spread.withColumn("bucket", bucket).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((c("rows") - 1) / BUCKET))))
    each = F.least(F.lit(BUCKET), c("rows") - c("part") * BUCKET).cast("int")
    row = F.struct(c("size"), c("key"), (c("part") * BUCKET).alias("from"), each.alias("n"), c("rate"))
    groups = spread.groupBy("source", "source_size", "target", "bucket", "part").agg(F.collect_list(row).alias("rows"))
    expanded = F.flatten(F.transform("rows", lambda r: F.transform(F.sequence(F.lit(0), r["n"] - 1), lambda i: F.struct((-r["size"]).alias("order"), r["key"].alias("key"), (r["from"] + i).alias("again"), r["size"].alias("size"), r["rate"].alias("rate")))))
    groups = groups.withColumn("rows", F.array_sort(expanded))
    groups = groups.withColumn("copies", _round(c("rows"), most))
    flat = groups.select("source", "source_size", "target", F.explode(F.arrays_zip("rows", "copies")).alias("x"))
    return flat.select(
        c("x.rows.key").alias(key), c("x.rows.again").alias("again"), "source", c("x.rows.size").alias("size"), "source_size", "target", c("x.rows.rate").alias("rate"),
        c("x.copies").alias("copies"), (c("x.copies") * c("x.rows.size")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents that the mix takes, each row of `docs` once, with `copies` and `taken` added.

    Documents with the same doc_id, source and size that get different numbers
    of copies share them in the order of their texts.  Null texts and empty
    ones are never taken; null ids and sources are like others; columns
    `copies` and `taken` are replaced; an empty table stays empty.
    """
    names = [c for c in docs.columns if c not in ("copies", "taken")]
    key, source, size, again, words, nth, copies, taken = (fresh_name(x, names) for x in ("its_key", "its_source", "its_size", "its_again", "its_words", "its_nth", "its_copies", "its_taken"))
    took = Tables(docs.sparkSession).keep(mix(docs, "doc_id", weights, most).select(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("size").alias(size), F.col("again").alias(again), F.col("copies").alias(copies), F.col("taken").alias(taken)))
    marked = docs.select(*names, n_words().alias(words))
    place = F.lit(0)
    if took.where(F.col(again) > 0).limit(1).count():  # else no text has to be moved for it
        place = F.row_number().over(Window.partitionBy("doc_id", "source", words).orderBy(F.xxhash64("text"))) - 1
    marked = marked.withColumn(nth, place)
    same = F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(words) == F.col(size)) & (F.col(nth) == F.col(again))
    return marked.join(took, same).where(F.col(copies) > 0).select(*names, F.col(copies).alias("copies"), F.col(taken).alias("taken"))
