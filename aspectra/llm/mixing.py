"""Mixing sources to target weights by iterative proportional fitting (raking).

The rows, with their marginal values (source, language, topic) and tokens, are written once, so no
text is judged twice. Documents are summed into cells, one per combination of the values, with partial
aggregation first. A cell's weight is its share of ``keep`` times all tokens, and can't
exceed the tokens it has. Each round scales the cells' weights to one marginal after another, by
a window over the cells of each value, and holds a weight at its cell's bound; later rounds deal what
that leaves to the cells that have more. A document is kept with probability weight over bound, if a hash of
its id, as a fraction, is below it: no randomness, the same at every size.

Targets are first made reachable: a value whose documents together have fewer tokens than its share asks
gets all of them, and the other values of the marginal share the rest in proportion. ``residuals`` reports, per
value, the share wanted, the reachable target, the share reached and their difference.

Everything is DataFrame expressions. Cells are a small aggregate: up to ``ONE_TASK_CELLS``, which are
counted, all windows run in one task without an exchange, beyond it they are shuffled by value. Every few rounds the
cells are written to the shared folder, so plans and lineage stay short.

Defined cases: a null marginal value is the value ``(null)``; a target for a value that no document
has is ignored and the others are rescaled; a value without a target gets the mean of the given
ones; a target of zero keeps nothing of its value; a document without tokens weighs 1; a null id counts as the id ``(null)``;
repeated rows are documents of their own with the same decision; an empty table stays empty; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.functions.hashing import HASH_RANGE, portable_hash
from aspectra.llm.common import shuffles_freed, stash

ROUNDS = 24
ROUNDS_A_PLAN = 4
SEED = 42
ONE_TASK_CELLS = 100_000
BROADCAST_CELLS = 100_000


def tokens(text: Column) -> Column:
    """White-space tokens of a text, at least 1: the weight of a document."""
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.greatest(words, F.lit(1)).cast("double")


def occurrences(text: Column, marker: str) -> Column:
    """Places of an ASCII marker, by the bytes that go with it."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)


def topic(text: Column, topics: Mapping[str, Sequence[str]], other: str = "general") -> Column:
    """The topic whose markers (plain strings, as written) occur most often in the text; ties go to
    the first named, none is ``other``."""
    whole = F.coalesce(text, F.lit(""))
    counts = [sum((occurrences(whole, m) for m in markers), F.lit(0)) for markers in topics.values()]
    # One array, made once per row; the first of the greatest counts names the topic.
    held, names = F.array(*counts), F.array(*[F.lit(n) for n in topics])
    first = F.transform(F.array(held), lambda c: F.when(F.array_max(c) > 0, F.get(names, F.array_position(c, F.array_max(c)).cast("int") - 1)))
    return F.coalesce(F.get(first, 0), F.lit(other))


def targets(cells: DataFrame, col: str, wanted: Mapping[str, float] | None, power: float) -> DataFrame:
    """(col, wanted, target): shares that sum to 1, and the nearest ones that the values' bounds allow. Given
    weights, or, without any, the present shares raised to ``power`` (below 1: towards uniform)."""
    sums = cells.groupBy(col).agg(F.sum("tokens").alias("t"), F.sum("most").alias("most"))
    if wanted:
        share = F.coalesce(*[F.when(F.col(col) == k, F.lit(float(w))) for k, w in wanted.items()], F.lit(sum(wanted.values()) / len(wanted)))
    else:
        share = F.pow(F.col("t"), F.lit(power))
    raw, _ = stash(sums.select(col, share.alias("share"), "most"), "mix-target")
    whole = raw.agg(F.sum("share")).first()[0] or 1.0
    scale, full = 1.0 / whole, -1
    while True:  # more values reach their bound each time, or it ends
        bound = F.col("share") * F.lit(scale) >= F.col("most")
        held = raw.agg(F.count_if(bound).alias("n"), F.sum(F.when(bound, F.col("most"))).alias("most"), F.sum(F.when(~bound, F.col("share"))).alias("rest")).first()
        if held["n"] == full or not held["rest"]:
            break
        scale, full = max(0.0, 1.0 - (held["most"] or 0.0)) / held["rest"], held["n"]
    return raw.select(col, (F.col("share") / F.lit(whole)).alias("wanted"), F.least("most", F.col("share") * F.lit(scale)).alias("target"))


def rake(
    cells: DataFrame, wanted: Mapping[str, Mapping[str, float] | None], keep: float = 0.5, rounds: int = ROUNDS, power: float = 0.5
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Cells (marginal columns, ``tokens``) with ``most``, the share all their tokens would have, and ``weight``,
    their raked share of the mixture; and each marginal's targets."""
    whole = cells.agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).first()
    total = whole["tokens"] or 1.0
    small = whole["n"] <= ONE_TASK_CELLS
    bounded = cells.withColumn("most", F.col("tokens") / F.lit(float(keep) * total))
    goals = {c: targets(bounded, c, w, power) for c, w in wanted.items()}
    now = bounded.withColumn("weight", F.col("tokens") / F.lit(total))
    for c, goal in goals.items():
        now = now.join(goal.select(c, F.col("target").alias(f"target of {c}")), c)
    for k in range(0, rounds, ROUNDS_A_PLAN):
        now = now.coalesce(1) if small else now
        for _ in range(min(ROUNDS_A_PLAN, rounds - k)):
            for c in wanted:
                now = now.withColumn("present", F.sum("weight").over(Window.partitionBy(c)))
                scaled = F.when(F.col("present") > 0, F.col("weight") * (F.col(f"target of {c}") / F.col("present"))).otherwise(F.lit(0.0))
                now = now.withColumn("weight", F.least("most", scaled))
        now, _ = stash(now.drop("present"), "mix-cells")
    return now.select(*wanted, "tokens", "most", "weight"), goals


def residuals(raked: DataFrame, goals: Mapping[str, DataFrame]) -> DataFrame:
    """(marginal, value, wanted, target, reached, residual) of the raked cells."""
    out = None
    for c, goal in goals.items():
        reached = raked.groupBy(c).agg(F.sum("weight").alias("reached")).join(goal, c)
        part = reached.select(F.lit(c).alias("marginal"), F.col(c).alias("value"), "wanted", "target", "reached", F.abs(F.col("reached") - F.col("target")).alias("residual"))
        out = part if out is None else out.unionByName(part)
    return out


def cells_of(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return stash(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "mix-cells")[0]


def mix(
    docs: DataFrame, wanted: Mapping[str, Mapping[str, float] | None], columns: Mapping[str, Column], weight: Column,
    keep: float = 0.5, rounds: int = ROUNDS, power: float = 0.5, id_col: str = "doc_id", seed: int = SEED, carry: Sequence[str] | None = None,
) -> DataFrame:
    """All rows of ``docs`` in a struct ``doc`` (of the columns ``carry``, by default all), with the marginal values,
    ``tokens``, ``weight`` (the cell's share of the mixture), ``probability`` and ``kept``. ``columns`` gives each
    marginal of ``wanted`` as an expression, of a label or of the text."""
    names = list(wanted)
    values = [F.coalesce(columns[c].cast("string"), F.lit("(null)")).alias(c) for c in names]
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("(null)"))
    draw = portable_hash("mix", seed, key) / F.lit(float(HASH_RANGE))
    doc = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("doc")
    with shuffles_freed(docs.sparkSession):
        rows, _ = stash(docs.select(doc, *values, weight.alias("tokens"), draw.alias("draw")), "mix-rows")
        raked, _ = rake(cells_of(rows, names), wanted, keep, rounds, power)
    chance = raked.select(*names, "weight", (F.col("weight") / F.col("most")).alias("probability"))
    # Beyond the checked bound a shuffled join, whose large cells adaptive execution splits.
    out = rows.join(F.broadcast(chance) if raked.count() <= BROADCAST_CELLS else chance, names)
    return out.select("doc", *names, "tokens", "weight", "probability", (F.col("draw") < F.col("probability")).alias("kept"))
