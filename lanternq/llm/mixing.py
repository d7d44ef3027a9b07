"""Problem 9: mix sources to target shares of all tokens, with capped repeats, by Pareto order sampling.

Every document of a source gets its certain whole copies; the rest of the source's target is drawn as a sample of fixed
size with unequal probabilities: inclusion p grows with the document's size, documents are ranked by random odds over
inclusion odds, u/(1-u) / (p/(1-p)), and the first n are taken. The last place of each source is found by counting rank
classes and sorting only the class that holds it, so a document learns from one row per source whether it is drawn: no
source is sorted as a whole and no rows are joined to rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage

#: Classes of rank values; only the class that holds the last place of a source is sorted.
RANK_CLASSES = 1 << 16


def token_size(text: Column) -> Column:
    """Code points above 127 count one each, the others a quarter each, summed and rounded up; null is 0."""
    narrow = F.length(F.regexp_replace(text, r"[^\x00-\x7F]+", ""))
    return F.coalesce(F.length(text) - narrow + F.floor((narrow + 3) / 4), F.lit(0)).cast("long")


def uniform(seed: int, *columns: Column) -> Column:
    """A number inside 0..1 that depends on the columns only, so that a lost executor draws the same again."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in columns)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def allocation(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, total, tokens, documents, wanted, used, copies, rest, short): a row per target.

    sizes has (source, tokens, documents), once per source. total is the tokens of all documents of listed sources, wanted
    the target share of it, used what can be given, copies the certain whole copies of every document, rest the tokens
    still to be drawn, and short tells that tokens * max_repeats < wanted. A source without documents has 0 tokens; a null
    source matches nothing; a negative or null repeat cap counts as 0.
    """
    t = targets.select("source", "target_share", F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    a = t.join(sizes, "source", "left").fillna(0, ["tokens", "documents"])
    total = a.select("source", "tokens").distinct().agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    a = a.crossJoin(F.broadcast(total))  # one row
    a = a.withColumn("wanted", F.coalesce(F.col("target_share"), F.lit(0.0)) * F.col("total"))
    a = a.withColumn("short", F.col("tokens") * F.col("max_repeats") < F.col("wanted"))
    a = a.withColumn("used", F.least(F.col("wanted"), (F.col("tokens") * F.col("max_repeats")).cast("double")))
    a = a.withColumn("copies", F.when(F.col("tokens") > 0, F.floor(F.col("used") / F.col("tokens"))).otherwise(0).cast("int"))
    return a.withColumn("rest", F.col("used") - F.col("copies") * F.col("tokens"))


def inclusion(hist: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, c, largest_open, n): p = min(1, c * tokens) with sum(p * tokens) = rest, and the number of documents to draw.

    hist has (source, tokens, docs). The largest documents are certain until c fits the others.
    """
    hist = hist.filter("tokens > 0").join(plan.filter("rest > 0").select("source", "rest"), "source")
    down = Window.partitionBy("source").orderBy(F.desc("tokens"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("held", F.coalesce(F.sum(F.col("docs") * F.col("tokens")).over(above), F.lit(0)))
    hist = hist.withColumn("squares", F.sum(F.col("docs") * F.col("tokens").cast("double") * F.col("tokens")).over(down.rowsBetween(0, Window.unboundedFollowing)))
    hist = hist.withColumn("c", (F.col("rest") - F.col("held")) / F.col("squares"))
    own = Window.partitionBy("source")
    fits = F.when((F.col("rest") > F.col("held")) & (F.col("c") * F.col("tokens") <= 1), F.col("tokens"))
    hist = hist.withColumn("largest_open", F.coalesce(F.max(fits).over(own), F.lit(0)))
    hist = hist.withColumn("c", F.max(F.when(F.col("tokens") == F.col("largest_open"), F.col("c"))).over(own))
    p = F.when(F.col("tokens") > F.col("largest_open"), 1.0).otherwise(F.least(F.lit(1.0), F.col("c") * F.col("tokens")))
    return hist.groupBy("source").agg(F.coalesce(F.max("c"), F.lit(0.0)).alias("c"), F.max("largest_open").alias("largest_open"), F.round(F.sum(F.col("docs") * p)).cast("long").alias("n"))


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    The mixture is (key, source, tokens, copies) with a row for each document used at least once; copies never exceeds
    max_repeats. The report is the allocation with `reached` tokens and `reached_share` of the whole mixture. Documents of
    unlisted or null sources are left out; a document of 0 tokens only gets certain copies. Sources of targets are taken as
    unique. Ties in rank are set by key, then by the place of the row in the staged table. What is sent to every task is a
    row per target.
    """
    base = documents.select(F.col(key).alias("_key"), "source", token_size(F.col(text)).alias("tokens"))
    listed = F.broadcast(targets.select("source").distinct())  # a row per target
    base = stage(base.join(listed, "source", "left_semi").select("_key", "source", "tokens", F.monotonically_increasing_id().alias("_row")), "token-sizes")
    hist = stage(base.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("docs")), "sizes")
    per = hist.groupBy("source").agg(F.sum(F.col("docs") * F.col("tokens")).alias("tokens"), F.sum("docs").alias("documents"))
    plan = stage(allocation(per, targets), "allocation")
    open_ = stage(inclusion(hist, plan), "inclusion")

    u = uniform(seed, F.col("_key"))
    p = F.when(F.col("tokens") > F.col("largest_open"), 1.0).otherwise(F.least(F.lit(1.0), F.col("c") * F.col("tokens")))
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    drawn = base.join(F.broadcast(plan.select("source", F.col("copies").alias("_whole"))), "source").join(F.broadcast(open_), "source", "left")  # a row per target
    drawn = drawn.withColumn("p", F.when((F.col("tokens") > 0) & F.col("n").isNotNull(), p))
    drawn = drawn.withColumn("q", F.when(F.col("p") >= 1, 0.0).otherwise(odds / (1 + odds))).withColumn("bin", F.when(F.col("p") >= 1, -1).otherwise(F.floor(F.col("q") * RANK_CLASSES)))

    bins = drawn.filter("q is not null").groupBy("source", "bin", "n").agg(F.count(F.lit(1)).alias("docs"))
    order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("docs").over(order), F.lit(0)))
    ends = bins.withColumn("after", F.col("before") + F.col("docs")).filter("before < n").groupBy("source").agg(
        F.max(F.when(F.col("after") <= F.col("n"), F.col("bin"))).alias("full"),
        F.max(F.when(F.col("after") > F.col("n"), F.struct("bin", (F.col("n") - F.col("before")).alias("more")))).alias("edge"),
    )
    ends = stage(ends, "edges")
    inside = drawn.join(F.broadcast(ends.filter("edge is not null")), "source").filter("bin = edge.bin")  # a row per target
    place = F.row_number().over(Window.partitionBy("source").orderBy("q", "_key", "_row"))
    last = inside.withColumn("place", place).filter("place = edge.more").select("source", F.struct("q", "_key", "_row").alias("last"))
    ends = stage(ends.join(last, "source", "left"), "last-places")

    flagged = drawn.join(F.broadcast(ends), "source", "left")  # a row per target
    taken = (F.col("bin") <= F.col("full")) | ((F.col("bin") == F.col("edge.bin")) & (F.struct("q", "_key", "_row") <= F.col("last")))
    out = flagged.withColumn("copies", F.col("_whole") + F.when(F.coalesce(taken, F.lit(False)), 1).otherwise(0))
    mixture = stage(out.filter("copies > 0").select(F.col("_key").alias(key), "source", "tokens", "copies"), "mixture")
    reached = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"))
    report = plan.join(reached, "source", "left").fillna(0, ["reached"])
    whole = mixture.agg(F.coalesce(F.sum(F.col("tokens") * F.col("copies")), F.lit(0)).alias("whole"))
    report = report.crossJoin(F.broadcast(whole))  # one row
    return mixture, report.withColumn("reached_share", F.when(F.col("whole") > 0, F.col("reached") / F.col("whole")).otherwise(F.lit(0.0))).drop("whole")
