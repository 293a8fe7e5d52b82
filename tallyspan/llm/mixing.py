"""Mixing sources to target weights (problem 7).

Sizes are tokens of the public tokenizer. Cells of source, language and topic are raked by iterative proportional
fitting: to the target tokens of every source, and to the shares that languages and topics have among the documents of
the mix's sources, with no cell used more often than its source may repeat. The cells of all mixes stay a table in Spark; a
step of a round sums it by one marginal and joins the sums. A cell's factor gives every document its whole copies; one more
copy is drawn with the factor's fraction as probability. The draw goes by ascending u / fraction (u: a hash of mix and
document) until the source's tokens are reached, so that a source is met to within a document.

Defined results: documents without tokens and sources without target are in no mix. A source whose documents, repeated as
often as allowed, don't reach its target gives all it may, and no other source makes up for it; the reports show what was
reached. Null languages are 'und', titles without topic 'none'. Repeated document ids are separate documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.llm.tokenizing import count_tokens
from tallyspan.session import cut

#: Rounds of raking at most, and the share of all tokens that changes its cell in a round at which it ends before.
ROUNDS, TOLERANCE = 15, 1e-3
#: Steps that hand out what capped cells leave over, until every source is met to ``EXACT``.
SOURCE_STEPS, EXACT = 12, 1e-6
#: Parts into which a range of the drawing order is cut, and rows that a task may sort to find where a draw ends.
BUCKETS, SORTED_ROWS = 2048, 100_000
MARGINALS = ("source", "language", "topic")


def sized_documents(documents: DataFrame, model: bytes | None = None) -> DataFrame:
    """doc_id, source, language, topic and n_tokens of every document."""
    narrow = documents.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.nullif(F.lower(F.regexp_extract("lang", r"^\s*([A-Za-z]{2})", 1)), F.lit("")), F.lit("und")).alias("language"),
        F.coalesce(F.nullif(F.lower(F.trim(F.regexp_extract("title", r"\s[–—-]\s(.+)$", 1))), F.lit("")), F.lit("none")).alias("topic"),
        "text",
    )
    return count_tokens(narrow, model=model)


def goals(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, cap (repeats) and goal (tokens) of every source of every mix; weights are divided by their sum."""
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("__total"))  # one row
    asked = targets.where(F.col("source").isNotNull()).groupBy("mix_name", "source").agg(
        F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"), F.max("total_fraction").alias("fraction")
    )
    all_shares = F.sum("share").over(W.partitionBy("mix_name"))  # a row per source of the mix
    return asked.crossJoin(F.broadcast(total)).select(
        "mix_name", "source", "cap", (F.col("share") / all_shares * F.col("fraction") * F.col("__total")).alias("goal")
    )


def rake(cells: DataFrame, goal: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """mix_name, source, language, topic, tokens and factor of every cell: how often its documents are used.

    ``cells``: source, language, topic, tokens. ``goal``: mix_name, source, cap, goal.
    """
    held = cells.where("tokens > 0").join(goal, "source")
    reach = held.groupBy("mix_name", "source").agg(F.least(F.first("goal"), F.sum(F.col("cap") * F.col("tokens"))).alias("reach"))
    mixes = reach.groupBy("mix_name").agg(F.sum("reach").alias("whole"))
    start = held.select("mix_name", *MARGINALS, "tokens", (F.col("cap") * F.col("tokens")).cast("double").alias("most"))
    # A cell carries what it is raked to: its source's reachable tokens, and its language's and topic's shares of the whole.
    # Dozens of broadcasts would fill the driver; a shuffled join splits a hot language or source by AQE.
    beside = lambda sums: sums.hint("shuffle_hash")
    state = start.join(beside(reach), ["mix_name", "source"]).join(beside(mixes), "mix_name")
    everything = start.groupBy("mix_name").agg(F.sum("tokens").alias("__all"))
    for column in ("language", "topic"):
        share = start.groupBy("mix_name", column).agg(F.sum("tokens").alias("__of")).join(everything, "mix_name")
        state = state.join(beside(share.select("mix_name", column, (F.col("__of") / F.col("__all")).alias(f"share_{column}"))), ["mix_name", column])
    state = cut(state.withColumn("weight", F.least(F.col("tokens").cast("double"), F.col("most"))))

    def to_marginal(cells: DataFrame, column: str) -> DataFrame:
        sums = cells.groupBy("mix_name", column).agg(F.sum("weight").alias("__have"))
        scale = F.try_divide(F.col(f"share_{column}") * F.col("whole"), F.col("__have"))
        scaled = F.least(F.col("weight") * F.coalesce(scale, F.lit(1.0)), F.col("most"))
        return cells.join(beside(sums), ["mix_name", column]).withColumn("weight", scaled).drop("__have")

    def to_source(cells: DataFrame) -> DataFrame:
        free = F.col("weight") < F.col("most") * (1 - 1e-12)
        sums = cells.groupBy("mix_name", "source").agg(
            F.sum(F.when(~free, F.col("weight")).otherwise(0.0)).alias("__capped"), F.sum(F.when(free, F.col("weight")).otherwise(0.0)).alias("__room")
        )
        held = F.col("__capped") + F.col("__room")
        down = F.when(held >= F.col("reach"), F.col("weight") * F.try_divide("reach", held))
        up = F.least(F.col("weight") * F.coalesce(F.try_divide(F.col("reach") - F.col("__capped"), F.col("__room")), F.lit(1.0)), F.col("most"))
        given = F.coalesce(down, F.when(free, up), F.col("weight"))
        return cells.join(beside(sums), ["mix_name", "source"]).withColumn("weight", given).drop("__capped", "__room")

    for _ in range(rounds):
        new = to_source(to_marginal(to_marginal(state.withColumn("__before", F.col("weight")), "language"), "topic"))
        state = cut(new)
        moved = state.agg(F.try_divide(F.sum(F.abs(F.col("weight") - F.col("__before"))), F.sum("__before"))).first()[0]
        state = state.drop("__before")
        if moved is None or moved <= TOLERANCE:
            break
    for _ in range(SOURCE_STEPS):
        off = state.groupBy("mix_name", "source").agg((F.abs(F.sum("weight") - F.first("reach")) / F.greatest(F.first("reach"), F.lit(1.0))).alias("off"))
        worst = off.agg(F.max("off")).first()[0]
        if worst is None or worst <= EXACT:
            break
        state = cut(to_source(state))
    return state.select("mix_name", *MARGINALS, "tokens", (F.col("weight") / F.col("tokens")).alias("factor"))


def _drawn(weighted: DataFrame) -> DataFrame:
    """Add ``extra`` (0 or 1): the draw by ascending u / part up to the tokens that the parts of a source add up to.

    The order is mapped to 0..1 and cut into ``BUCKETS``; buckets before the one in which the tokens are reached are taken
    whole, those after it left out, and the rows of that one bucket are cut again until a task can sort them.
    """
    keys = ["mix_name", "source"]
    unit = (F.xxhash64("mix_name", "doc_id").bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    marked = weighted.withColumn("at", F.when(F.col("part") > 1e-9, unit / (unit + F.col("part"))))
    rest = weighted.groupBy(*keys).agg(F.sum(F.col("part") * F.col("n_tokens")).alias("rest"))
    done = [marked.where("at is null").withColumn("extra", F.lit(0))]
    open_, low, width = marked.where("at is not null").withColumn("low", F.lit(0.0)), F.col("low"), 1.0
    kept = [*weighted.columns, "extra"]
    for level in range(5):
        held = open_.withColumn("bucket", F.greatest(F.lit(0), F.least(F.floor((F.col("at") - low) * (BUCKETS / width)), F.lit(BUCKETS - 1))).cast("int"))
        heaps = held.groupBy(*keys, "bucket").agg(F.sum("n_tokens").alias("t"))
        upto = W.partitionBy(*keys).orderBy("bucket")  # at most BUCKETS rows
        edge = (
            heaps.withColumn("until", F.sum("t").over(upto))
            .join(rest, keys)
            .where((F.col("until") > F.col("rest")) & (F.col("until") - F.col("t") <= F.col("rest")))
            .select(*keys, F.col("bucket").alias("edge"), (F.col("rest") - F.col("until") + F.col("t")).alias("__rest"))
        )
        edge = cut(edge)  # a row per mix and source
        near = held.join(edge, keys, "left")
        done.append(
            near.where("edge is null or bucket <> edge").withColumn("extra", (F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))).cast("int"))
        )
        width /= BUCKETS
        open_ = cut(near.where("bucket = edge").withColumn("low", F.col("low") + F.col("bucket") * width).select(*weighted.columns, "at", "low"))
        rest = edge.select(*keys, F.col("__rest").alias("rest"))
        most = open_.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if most is None or most <= SORTED_ROWS:
            break
    within = W.partitionBy(*keys).orderBy("at", "doc_id")
    last = open_.join(rest, keys).withColumn("running", F.sum("n_tokens").over(within))
    done.append(last.withColumn("extra", (F.col("running") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int")))
    return reduce(DataFrame.unionByName, [d.select(*kept) for d in done])


def mix_copies(documents: DataFrame, targets: DataFrame, model: bytes | None = None, sized: DataFrame | None = None) -> DataFrame:
    """mix_name, doc_id, source, n_tokens and copies of every document that a mix holds."""
    sized = cut(sized_documents(documents, model)) if sized is None else sized
    goal = cut(goals(sized, targets))
    used = sized.where("n_tokens > 0").join(goal.select("source").distinct(), "source", "left_semi")
    cells = cut(used.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("tokens")))
    factor = rake(cells, goal).drop("tokens")
    weighted = used.join(factor, list(MARGINALS)).select(
        "mix_name",
        "doc_id",
        "source",
        "n_tokens",
        F.floor(F.col("factor") + 1e-9).alias("base"),
        F.greatest(F.col("factor") - F.floor(F.col("factor") + 1e-9), F.lit(0.0)).alias("part"),
    )
    copies = (F.col("base") + F.col("extra")).cast("int").alias("copies")
    return _drawn(weighted).select("mix_name", "doc_id", "source", "n_tokens", copies).where("copies > 0")


def mix_rows(copies: DataFrame) -> DataFrame:
    """One row for every use of a document: mix_name, doc_id, repeat (from 1)."""
    return copies.select("mix_name", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("repeat"))


def mix_report(documents: DataFrame, targets: DataFrame, model: bytes | None = None) -> DataFrame:
    """Target and reached tokens and shares of every source of every mix, and its most used document's copies."""
    sized = cut(sized_documents(documents, model))
    copies = mix_copies(documents, targets, model, sized)
    reached = copies.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    total = sized.agg(F.sum("n_tokens").alias("corpus"))
    mix = W.partitionBy("mix_name")
    return (
        targets.join(F.broadcast(total))
        .join(reached, ["mix_name", "source"], "left")
        .select(
            "mix_name",
            "source",
            (F.col("target_share") / F.sum("target_share").over(mix)).alias("target_share"),
            (F.col("target_share") / F.sum("target_share").over(mix) * F.col("total_fraction") * F.col("corpus")).alias("target_tokens"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.try_divide(F.coalesce("tokens", F.lit(0)), F.sum("tokens").over(mix)).alias("reached_share"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            "max_repeats",
        )
    )


def marginal_report(documents: DataFrame, targets: DataFrame, model: bytes | None = None) -> DataFrame:
    """mix_name, marginal ('language' or 'topic'), value, target_share and reached_share of tokens.

    The target is the share that the value has among the documents of the mix's sources; caps on repeats and sources that
    don't reach their target keep mixes from it.
    """
    sized = cut(sized_documents(documents, model))
    copies = mix_copies(documents, targets, model, sized)
    names = targets.where(F.col("source").isNotNull()).select("mix_name", "source").distinct()
    value = F.explode(F.array(*[F.struct(F.lit(m).alias("marginal"), F.col(m).alias("value")) for m in MARGINALS[1:]])).alias("x")
    asked = sized.where("n_tokens > 0").join(names, "source").select("mix_name", "n_tokens", value).groupBy("mix_name", "x.marginal", "x.value").agg(F.sum("n_tokens").alias("t"))
    used = copies.groupBy("mix_name", "doc_id").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n"))
    kinds = sized.groupBy("doc_id").agg(F.first("language").alias("language"), F.first("topic").alias("topic"))
    reached = used.join(kinds, "doc_id").select("mix_name", "n", value).groupBy("mix_name", "x.marginal", "x.value").agg(F.sum("n").alias("r"))
    whole = W.partitionBy("mix_name", "marginal")
    return asked.join(reached, ["mix_name", "marginal", "value"], "left").select(
        "mix_name",
        "marginal",
        "value",
        (F.col("t") / F.sum("t").over(whole)).alias("target_share"),
        F.try_divide(F.coalesce("r", F.lit(0)), F.sum("r").over(whole)).alias("reached_share"),
    )
