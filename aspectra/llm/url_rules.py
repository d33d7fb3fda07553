"""URL filter: listed rules decide what they fit, association rules mined from those decisions the rest.

1. A listed rule ``host/path`` fits its host and all subdomains where the url's path starts with the rule's; the
   longest wins. The urls it decides are the labelled ones.
2. A url's tokens are its scheme, host labels, and the words of its path and of its query and fragment. Those that
   enough labelled urls have, all of them, make a labelled url's items.
3. Sets of items are counted level by level, each set from its subsets (Apriori). Kept are rules tokens -> verdict of enough support and
   confidence, less those with a more general rule that is no less certain: they can never decide. Sets all of whose supersets are
   such rules are not extended.
4. Every other url meets the rules through an inverted index, each rule listed under its rarest token, and has to
   hold all of the rule's tokens. The rule of highest confidence, then support, decides (``block`` before ``allow``);
   without any, the verdict is ``default``.

All of it is DataFrame expressions. No token, set or rule is left out by a bound on their number: tokens that always stand together, and
those that settle the verdict, are not combined any further, so the sets are those that still tell urls apart.

Defined cases: a url that is null or has no ``://`` has an empty host, an empty path and no tokens, so ``default`` decides; an
empty path starts with no rule's path. Repeated rows and null ids are rows of their own. Without labelled rows no rule
is mined; an empty table stays empty. Other columns are ignored, whatever their names. The listed rules are part of
the plan: some hundreds, not millions.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import fits_broadcast, stash
from aspectra.operators.match import salted_join

MIN_SUPPORT, MIN_CONFIDENCE = 0.02, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column, Column]:
    """(scheme, host, path, rest); all empty without ``://``."""
    at = F.instr(url, "://")
    known = at > 0
    after = F.substr(url, at + 3)
    part = lambda c: F.when(known, c).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    path, rest = (F.regexp_extract(after, r"^[^/?#]*([^?#]*)([\s\S]*)", k) for k in (1, 2))
    return part(F.substr(url, F.lit(1), at - 1)), part(host), part(path), part(rest)


def tokens(scheme: Column, host: Column, path: Column, rest: Column) -> Column:
    """Distinct tokens of a url: ``s:`` scheme, ``h:`` host label, ``p:`` word of the path, ``q:`` word of what follows it."""

    def words(prefix, text):
        found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(r"[\p{L}\p{N}]+"), 0)
        return F.transform(found, lambda w: F.concat(F.lit(prefix), w))

    return F.array_distinct(F.concat(words("s:", scheme), words("h:", host), words("p:", path), words("q:", rest)))


def listed_rule(host: Column, path: Column, rules: Mapping[str, str]) -> Column:
    """The longest listed rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        rule_host, slash, rule_path = rule.partition("/")
        inside = (host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))
        out = F.when(inside & F.startswith(path, F.lit(slash + rule_path)), F.lit(rule)).otherwise(out)
    return out


def counted(held: DataFrame, n: int, min_support: float) -> DataFrame:
    """(set, n, told): rows that hold a set, and of each verdict that enough of all ``n`` rows share with it (verdict, n)."""
    by = held.groupBy("set", "verdict").agg(F.count(F.lit(1)).alias("n"))
    told = F.collect_list(F.when(F.col("n") >= F.lit(min_support * n), F.struct("verdict", "n"))).alias("told")
    return by.groupBy("set").agg(F.sum("n").alias("n"), told, F.count(F.lit(1)).alias("verdicts")).where(F.size("told") > 0)


def extended(sets: DataFrame, k: int) -> DataFrame:
    """(set, next, least): every set of k + 1 tokens, as its first k and its last, all of whose subsets of k are in ``sets``;
    ``least`` is how many rows the rarest subset has."""
    ends = sets.select("set", F.slice("set", 1, k - 1).alias("head"), F.col("set")[k - 1].alias("last"))
    other = ends.select("head", F.col("last").alias("next"))
    pairs = ends.join(other, "head").where(F.col("next") > F.col("last")).select("set", "next")
    whole = F.concat("set", F.array("next"))
    subsets = F.transform(whole, lambda t: F.array_remove(whole, t))
    each = pairs.select(F.col("set").alias("first"), "next", F.explode(subsets).alias("set")).join(sets.select("set", "n"), "set")
    found = each.groupBy("first", "next").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where(F.col("k") == k + 1)
    return found.select(F.col("first").alias("set"), "next", "least")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, verdict, confidence, support): the rules that can decide; ``tokens`` in order.

    Sets grow by a token at a time, with all frequent tokens of a url. A set is extended unless no superset of it can decide: it is
    held with no verdict often enough, all its rows have the same verdict (no rule is more certain than it), or it
    has as many rows as one of its own subsets (a superset decides as the one without the needless token does).
    """
    # Support is a share of the labelled urls that have a frequent token.
    rows = labelled.where(F.size("tokens") > 0).select("row", "verdict", F.array_distinct("tokens").alias("tokens"))
    each = rows.select("row", "verdict", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.lit(min_support * rows.count()))
    frequent, _ = stash(seen.select("token"), "url-tokens")
    met = each.join(F.broadcast(frequent), "token") if fits_broadcast(frequent) else salted_join(each, frequent, "token", ["row"])
    each, _ = stash(met, "url-items")
    total = each.select("row").distinct().count()
    level, _ = stash(counted(each.select(F.array("token").alias("set"), "verdict"), total, min_support), "url-sets")
    grow = level.where("verdicts > 1")
    single = grow.select(F.col("set")[0].alias("token"))
    met = each.join(F.broadcast(single), "token") if fits_broadcast(single) else salted_join(each, single, "token", ["row"])
    items = met.groupBy("row").agg(F.any_value("verdict").alias("verdict"), F.array_sort(F.collect_list("token")).alias("items"))
    held, levels, k = items.select("*", F.explode(F.transform("items", lambda t: F.array(t))).alias("set")), [level], 1
    held, _ = stash(held, "url-held")
    while True:
        more, _ = stash(extended(grow, k), "url-extended")
        if more.isEmpty():
            break
        met = held.join(F.broadcast(more), "set") if fits_broadcast(more) else salted_join(held, more, "set", ["row"])
        met = met.where(F.array_contains("items", F.col("next")))
        held, _ = stash(met.select("row", "verdict", "items", F.concat("set", F.array("next")).alias("set")), "url-held")
        least = more.select(F.concat("set", F.array("next")).alias("set"), "least")
        level, _ = stash(counted(held, total, min_support).join(least, "set"), "url-sets")
        grow, k = level.where((F.col("verdicts") > 1) & (F.col("n") < F.col("least"))), k + 1
        levels.append(level.drop("least"))
        going = grow.select("set")
        held = held.join(F.broadcast(going), "set", "left_semi") if fits_broadcast(going) else salted_join(held, going, "set", ["row"])
    found = reduce(DataFrame.unionByName, levels).select(F.col("set").alias("tokens"), F.col("n").alias("_n"), F.inline("told"))
    double = lambda c: F.col(c).cast("double")
    found = found.select("tokens", "verdict", (double("n") / double("_n")).alias("confidence"), (double("n") / F.lit(float(max(total, 1)))).alias("support"))
    rules, _ = stash(found.where(F.col("confidence") >= F.lit(min_confidence)), "url-mined")
    # A rule's generalisations are its own tokens less one.
    general = rules.select(
        F.col("tokens").alias("general"), F.col("verdict").alias("_v"), F.col("confidence").alias("_c")
    )
    less = F.explode(F.transform("tokens", lambda t: F.array_except(F.col("tokens"), F.array(t)))).alias("general")
    idle = rules.select("tokens", "verdict", "confidence", less).join(general, "general")
    idle = idle.where((F.col("verdict") == F.col("_v")) & (F.col("_c") >= F.col("confidence"))).select("tokens", "verdict")
    return stash(rules.join(idle, ["tokens", "verdict"], "left_anti"), "url-rules")[0]


def index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """The rules, each under the token of its own that the fewest of ``urls`` have."""
    named = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode("tokens").alias("token"))
    seen = seen.join(F.broadcast(named), "token", "left_semi") if fits_broadcast(named) else salted_join(seen, named, "token", ["token"])
    counted = named.join(seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))
    each = rules.select("*", F.explode("tokens").alias("token")).join(counted, "token")
    by = ["tokens", "verdict", "confidence", "support"]
    return each.groupBy(*by).agg(F.min_by("token", F.struct("n", "token")).alias("token"))


def decide(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, verdict, tokens, confidence, support): the mined rule that decides a url, for urls that any fits."""
    listed, _ = stash(index(rules, urls), "url-index")
    listed = listed.withColumnRenamed("tokens", "needs")
    each = urls.select("row", "tokens", F.explode("tokens").alias("token"))
    met = each.join(F.broadcast(listed), "token") if fits_broadcast(listed) else salted_join(each, listed, "token", ["row"])
    fit = met.where(F.forall("needs", lambda t: F.array_contains("tokens", t)))
    best = F.max(F.struct("confidence", "support", (F.col("verdict") == "block").alias("_block"), "verdict", "needs")).alias("b")
    return fit.groupBy("row").agg(best).select("row", "b.verdict", F.col("b.needs").alias("tokens"), "b.confidence", "b.support")


def judge(
    pages: DataFrame, rules: Mapping[str, str], id_col: str = "page_id", url_col: str = "url", min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE, default: str = "allow",
) -> DataFrame:
    """Every row: the id column, ``host``, ``path``, ``rule`` (the listed rule, or null), ``verdict``, and ``mined`` (the tokens
    of the mined rule that decided, or null) with its ``confidence``."""
    scheme, host, path, rest = parts(F.col(url_col))
    rule = listed_rule(F.col("host"), F.col("path"), rules)
    split = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), tokens(scheme, host, path, rest).alias("tokens"))
    named = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else F.create_map().cast("map<string,string>")
    rows = split.select(F.monotonically_increasing_id().alias("row"), "*", rule.alias("rule"))
    rows, _ = stash(rows.withColumn("verdict", F.try_element_at(named, F.col("rule"))), "url-rows")
    mined = mine(rows.where("rule is not null").select("row", "tokens", "verdict"), min_support, min_confidence)
    found = decide(rows.where("rule is null").select("row", "tokens"), mined)
    out = rows.drop("tokens").join(found.select("row", F.col("verdict").alias("_mined"), F.col("tokens").alias("mined"), "confidence"), "row", "left")
    return out.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", "_mined", F.lit(default)).alias("verdict"), "mined", "confidence"
    )
